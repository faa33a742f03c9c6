"""Programs on Spark: small cases, errors, and random programs against the plain evaluator."""

from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.cli import main
from quern.errors import ProgramError
from quern.operators.components import distributed_roots, local_roots
from quern.plans.query import variants
from quern.program import Program
from quern.syntax import Do, Rule, parse
from tests.naive import Naive, state_of

REACH = "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge x y)) ((path x y))) (rule ((path x y) (edge y z)) ((path x z)))"
NODES = "(sort Node) (function node (i64) Node) (relation edge (Node Node)) (relation path (Node Node)) (rule ((edge x y)) ((path x y))) (rule ((path x y) (edge y z)) ((path x z)))"
LENGTH = "(function edge (i64 i64) i64) (function path (i64 i64) i64 :merge (min old new)) (rule ((= (edge x y) n)) ((set (path x y) n))) (rule ((= (path x y) a) (= (edge y z) b)) ((set (path x z) (+ a b))))"


def run(spark, *texts, **options):
    p = Program(spark, **options)
    for t in texts:
        p.execute(t)
    return p


def same(spark, *texts, **options):
    """The program, after checking it against the plain evaluator."""
    p, n = run(spark, *texts, **options), Naive()
    n.execute(" ".join(texts))
    assert state_of(p) == n.state()
    return p


def test_reach(spark):
    p = same(spark, f"{REACH} (edge 5 8) (edge 8 2) (edge 2 6) (edge 6 9) (run)")
    assert p.size("path") == 10 and p.check("(path 5 9)") and not p.check("(path 9 5)")


def test_path_length(spark):
    p = same(spark, f"{LENGTH} (set (edge 4 7) 3) (set (edge 7 9) 8) (set (edge 4 9) 12) (set (edge 9 4) 1) (run)")
    assert p.check("(= (path 4 9) 11)") and p.check("(= (path 7 7) 12)") and p.size("path") == 9


@pytest.mark.parametrize("driver_links", [100_000, 0])
def test_union_before_reach(spark, driver_links):
    p = same(spark, f"{NODES} (edge (node 10) (node 11)) (edge (node 12) (node 13)) (edge (node 13) (node 14)) (union (node 11) (node 12)) (union (node 14) (node 15)) (run)", driver_links=driver_links)
    assert p.check("(edge (node 11) (node 13))") and p.check("(path (node 10) (node 15))") and not p.check("(path (node 14) (node 10))")
    assert [p.size(n) for n in ("node", "edge", "path")] == [6, 3, 6]


# Switching algebra: an algebra of our own
SWITCH = """
(datatype Gate (Pin i64) (Both Gate Gate) (Some Gate Gate) (Flip Gate) (High) (Low))
(rewrite (Both p q) (Both q p)) (rewrite (Some p q) (Some q p))
(rewrite (Flip (Flip p)) p) (rewrite (Flip (Both p q)) (Some (Flip p) (Flip q)))
(rewrite (Both p (High)) p) (rewrite (Both p (Low)) (Low)) (rewrite (Some p (Flip p)) (High))
(rewrite (Both p (Some q r)) (Some (Both p q) (Both p r))) (rewrite (Both p p) p)
"""


def test_equality_saturation(spark):
    p = same(spark, SWITCH + "(let left (Both (Pin 5) (Some (Pin 6) (Flip (Pin 6))))) (let wide (Flip (Both (Flip (Pin 5)) (Pin 7)))) (let other (Some (Flip (Pin 7)) (Pin 5))) (run 4)")
    assert p.check("(= (left) (Pin 5))") is p.check("(= (left) (Both (Pin 5) (High)))") is True
    assert p.check("(= (wide) (Some (Pin 5) (Flip (Pin 7))))") and not p.check("(= (left) (wide))")


def test_switching_algebra(spark):
    same(spark, SWITCH + "(Both (Some (Pin 1) (Pin 2)) (Both (Pin 3) (Flip (Both (Pin 1) (Low))))) (Some (Flip (Some (Pin 2) (Pin 4))) (Both (Pin 4) (Pin 4))) (run 3)")


def test_symbolic_mathematics(spark):
    """The load of the benchmark, as far as the plain evaluator reaches in seconds."""
    text, rest = (Path(__file__).parent / "fixtures" / "symbolic_math.txt").read_text(encoding="utf-8").split("(run 10)")
    commands = parse(text)
    assert sum(isinstance(c, Rule) for c in commands) == 24 and sum(isinstance(c, Do) for c in commands) == 7
    p = same(spark, text, "(run 3)")
    assert p.execute(rest)[:2] == ["Function Add has size 69", "Function Mul has size 77"]


def test_stream_batches_that_come_again_count_once(spark, tmp_path):
    from quern.streaming.incremental import stream_facts

    p = run(spark, "(function total (i64) i64 :merge (+ old new))")
    spark.createDataFrame([(1, 5), (2, 7)], "k long, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
    stream_facts(p, "total", stream, ["k", "v"], str(tmp_path / "c")).awaitTermination()
    for f in (tmp_path / "c" / "commits").iterdir():  # as if the batch had failed before it was noted as done
        f.unlink()
    stream_facts(p, "total", stream, ["k", "v"], str(tmp_path / "c")).awaitTermination()
    assert {r["c0"]: r["out"] for r in p.table("total").collect()} == {1: 5, 2: 7}


def test_many_iterations_keep_few_parts_and_exact_counts(spark):
    """Versions, dead rows and merged parts: counts stay exact, and reading agrees with the plain evaluator."""
    text = LENGTH + "".join(f"(set (edge {i} {i + 1}) {9 - i % 3}) (set (edge {i} {(i * 5 + 2) % 12}) 30)" for i in range(11)) + "(run)"
    p = same(spark, text)
    for t in p.tables.values():
        assert t.count() == t.rows().count() == t.live and len(t.parts) <= 8


def test_rules_added_later_and_facts_between_runs(spark):
    p = run(spark, REACH, "(edge 1 2) (edge 2 3) (run)", "(relation back (i64 i64)) (rule ((path x y)) ((back y x)))", "(edge 3 4) (run)")
    assert p.size("path") == 6 and p.size("back") == 6
    p.execute("(edge 4 1)")
    report = p.run(1)
    assert report.iterations == 1 and p.size("path") < 16
    p.run()
    assert p.size("path") == 16 == p.size("back")
    assert p.run().iterations == 1 and p.run(0).iterations == 0


def test_merges(spark):
    text = "(relation in (i64 i64)) (function {n} (i64) i64 :merge {m}) (rule ((in k v)) ((set ({n} k) v))) (in 1 5) (in 1 3) (in 2 -4) (in 1 9) (run) (in 1 4) (in 3 0) (run)"
    for name, merge, want in [("lo", "(min old new)", {1: 3, 2: -4, 3: 0}), ("sum", "(+ new old)", {1: 21, 2: -4, 3: 0}), ("mul", "(* old new)", {1: 540, 2: -4, 3: 0}), ("first", "old", {1: 3, 2: -4, 3: 0}), ("last", "new", {1: 4, 2: -4, 3: 0}), ("fold", "(+ old (* 10 new))", {1: 183, 2: -4, 3: 0})]:
        p = run(spark, text.format(n=name, m=merge))
        assert {r["c0"]: r["out"] for r in p.table(name).collect()} == want, name


def test_sums_count_every_binding(spark):
    p = run(spark, "(relation r (i64 i64)) (function s () i64 :merge (+ old new)) (rule ((r x y)) ((set (s) x))) (r 1 1) (r 1 2) (r 2 5) (run)")
    assert p.table("s").collect()[0]["out"] == 4


def test_conflicts_leave_the_tables_as_they_were(spark):
    p = run(spark, "(relation r (i64 i64)) (relation q (i64)) (function f (i64) i64) (rule ((r x y)) ((set (f x) y))) (rule ((r x y)) ((q x))) (r 1 2) (run) (r 1 3) (r 5 5)")
    with pytest.raises(ProgramError, match="2 != 3 in f"):
        p.run()
    assert p.size("f") == 1 and p.size("q") == 1 and p.size("r") == 3
    p.execute("(set (f 1) 2)")
    with pytest.raises(ProgramError, match="!= .* in f"):
        p.execute("(set (f 9) 1) (set (f 9) 2)")


def test_lookups_in_heads(spark):
    text = "(function home (i64) i64) (relation r (i64)) (function out (i64) i64) (rule ((r x)) ((set (out x) (+ 1 (home x))))) (set (home 1) 7) (r 1) (run)"
    p = same(spark, text)
    p.execute("(r 2)")
    with pytest.raises(ProgramError, match=r"unknown value \(home x\)"):
        p.run()
    p.execute("(home 5)")  # no output can be made up: nothing happens
    assert p.size("home") == 1


def test_patterns(spark):
    p = run(spark, '(relation r (i64 i64 String)) (function f (i64) i64) (r 1 1 "a") (r 1 2 "b") (r 2 2 "ü") (set (f 1) 2) (set (f 2) 2)')
    assert sorted(map(tuple, p.query("(r x x s)").collect())) == [("a", 1), ("ü", 2)]
    assert sorted(r.x for r in p.query('(r x y "b") (= (f x) y)').collect()) == [1]
    assert sorted(r.x for r in p.query("(r x y s) (= (+ x 1) y)").collect()) == [1]
    assert p.query("(f x)").count() == 2 and p.query("(r 7 y s)").count() == 0
    assert p.check("(= 1 1)") and not p.check("(= 1 2)") and p.check("(= (+ 1 2) 3)") and not p.check("(r 1 1 s) (= 1 2)")
    assert p.query("(r x y s) (r z w t)", ["x", "z"]).count() == 9
    assert p.query("(= (f x) (f y))", ["x", "y"]).count() == 4
    assert sorted(r.n for r in p.query("(= n (min (f x) x 1))", ["n"]).collect()) == [1, 1]


def test_equal_calls_are_one_atom(spark):
    from quern import syntax as S
    from quern.plans.query import analyse

    p = run(spark, "(function f (i64) i64) (relation r (i64))")
    q = analyse(tuple(map(S.pattern, S.read_lists("(= (f x) y) (r (f x)) (r y)"))), p.catalog)
    assert sorted(a.name for a in q.atoms) == ["f", "r"]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("(sort A) (sort A)", "A was declared twice"),
        ("(relation r (i64)) (relation r (i64))", "r was declared twice"),
        ("(relation r (A))", "unknown sort A"),
        ("(function + (i64) i64)", "+ is built in"),
        ("(relation r (i64)) (check (q 1))", "unknown function q"),
        ("(relation r (i64)) (check (r 1 2))", "r has 1 inputs"),
        ('(relation r (i64)) (r "a")', "expected i64, found String"),
        ('(relation r (i64)) (check (r "a"))', "expected i64"),
        ("(relation r (i64)) (rule ((r x)) ((r y)))", "unknown variable y"),
        ("(relation r (i64 i64)) (rule ((r a b) (= a b)) ())", "a and b refer to the same value"),
        ("(relation r (i64)) (rule ((r x) (= y (+ z 1))) ())", "query was not range-restricted"),
        ("(relation r (i64)) (rule ((r x) (= (min) x)) ())", "need at least one argument"),
        ("(function f (i64) i64 :merge (g old))", "unknown function g"),
        ("(function f (i64) i64 :merge x)", "unknown variable x"),
        ('(relation r (String)) (rule ((r x) (= (+ x 1) 2)) ())', "expected"),
        ("(sort A) (sort B) (relation r (A B)) (rule ((r a b)) ((union a b)))", "expected matching sorts"),
        ("(print-size q)", "no function q in database"),
        ("(relation r (i64)) (rule () ((r 1)))", "no patterns"),
        ("(relation r (i64)) (rule ((r x)) ((r (+ x 9223372036854775807)))) (r 1) (run 1)", "OVERFLOW"),
    ],
)
def test_errors(spark, text, error):
    with pytest.raises(ProgramError) as e:
        run(spark, text)
    assert error in str(e.value)


def test_rules_without_tables_never_fire_and_variables_can_be_united(spark):
    p = run(spark, "(relation r (i64)) (rule ((= x 1)) ((r x))) (run)", "(sort S) (function s (i64) S) (relation pair (S S)) (rule ((pair a b)) ((union a b))) (pair (s 1) (s 2)) (run)")
    assert p.size("r") == 0 and p.check("(= (s 1) (s 2))") and p.size("pair") == 1


def test_growth_guard_and_bounds(spark):
    with pytest.raises(ProgramError, match="allowed"):
        run(spark, "(relation n (i64)) (rule ((n x)) ((n (+ x 1)))) (n 0)", max_rows=20).run()
    p = run(spark, "(relation n (i64)) (rule ((n x)) ((n (+ x 1)))) (n 0) (run 12)")
    assert p.size("n") == 13 and len(p.tables["n"].parts) <= 7


def test_load(spark):
    p = run(spark, "(relation r (i64 String)) (function f (i64) i64) (datatype T (Leaf i64))")
    p.load("r", spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, s string"))
    p.load("f", spark.createDataFrame([("z", 5, 3)], "z string, v int, k long"), ["k", "v"])
    p.load("Leaf", spark.range(3))
    p.load("r", spark.createDataFrame([], "x int, s string"))
    assert [p.size(n) for n in ("r", "f", "Leaf")] == [2, 1, 3] and p.check("(= (f 3) 5)") and not p.check("(= (Leaf 1) (Leaf 2))")
    for name, df, error in [("r", spark.range(1), "takes 2 columns"), ("f", spark.createDataFrame([(1, 2.0)], "a int, b double"), "expected i64, found double"), ("f", spark.createDataFrame([(1, None)], "a int, b int"), "null in column b")]:
        with pytest.raises(ProgramError, match=error):
            p.load(name, df)
    assert p.size("f") == 1


def test_stream(spark, tmp_path):
    from quern.streaming.incremental import stream_facts

    spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "a long, b long").repartition(3).write.parquet(str(tmp_path / "in"))
    p = run(spark, REACH)
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_facts(p, "edge", stream, ["a", "b"], str(tmp_path / "checkpoint")).awaitTermination()
    assert p.size("path") == 28


def test_command_line(spark, tmp_path, capsys):
    file = tmp_path / "program.txt"
    file.write_text(f'{REACH} (relation s (String)) (s "a\\"b") (edge 1 2) (run) (check (path 1 2)) (check (path 2 1)) (print-size path) (print-stats)')
    assert main([str(file)], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith(f"failure: (check (path 2 1)) at {file}:1:") and out[1:5] == ["edge: 1 2 ()", "path: 1 2 ()", 's: "a\\"b" ()', ""]
    assert out[5] == "Function path has size 1" and out[6].startswith("Program has taken ") and out[6].endswith("s")
    assert main([], spark) == 1 and main([str(tmp_path / "none")], spark) == 1
    err = capsys.readouterr().err
    assert "usage: pass a" in err and "could not read" in err


def test_components(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(50)] + [("900", f"9{i:02}") for i in range(1, 30)] + [("500", "500")]
    p = Program(spark)
    table = p.space.save(spark.createDataFrame(links, "a string, b string"), "test")
    assert {r.id: r.root for r in distributed_roots(table, p.space).collect()} == local_roots(links)


def test_variants():
    assert variants([(0, 3), (5, 2)]) == [0] and variants([(1, 3), (5, 0)]) == [0] and variants([(1, 1), (1, 1), (0, 1)]) == [0, 1, 2]


nodes = st.integers(0, 4)
facts = st.lists(st.tuples(st.sampled_from(["a", "b"]), nodes, nodes), min_size=1, max_size=6)
unions = st.lists(st.tuples(nodes, nodes), max_size=2)
RULES = [
    "(rule ((a x y) (b y z)) ((a x z)))",
    "(rule ((a x x)) ((b x x)))",
    "(rule ((a x y) (a y x)) ((union x y)))",
    "(rule ((= (n i) x) (a x y)) ((set (w i) (+ i 10))))",
    "(rule ((b x y)) ((a (p x y) y)))",
    "(rule ((= (p x y) z) (b x w)) ((b w z)))",
    "(rule ((= (n i) x) (= (n j) y) (b x y)) ((c i (min i j 3))))",
    "(rule ((c i j) (= k (+ i j))) ((c i (min k 6))))",
]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(facts, unions, st.lists(st.sampled_from(RULES), min_size=2, max_size=4, unique=True))
def test_random_programs(spark, some, pairs, rules):
    text = "(sort N) (function n (i64) N) (function p (N N) N) (relation a (N N)) (relation b (N N)) (relation c (i64 i64)) (function w (i64) i64 :merge (min old new))"
    text += " ".join(rules) + " ".join(f"({r} (n {x}) (n {y}))" for r, x, y in some) + " ".join(f"(union (n {x}) (n {y}))" for x, y in pairs) + "(run 2)"
    same(spark, text).close()
