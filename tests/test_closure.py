"""Rules that compose a relation with pairs are run to their end in one step, with the rows of the plain loop."""

import numpy as np
import pytest

from quern.program import Program

REACH = "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge x y)) ((path x y)))"
STEPS = {"right": "(rule ((path x y) (edge y z)) ((path x z)))", "left": "(rule ((edge x y) (path y z)) ((path x z)))", "both": "(rule ((path x y) (path y z)) ((path x z)))"}


def closed(edges):
    out, more = set(edges), set(edges)
    while more:
        more = {(a, d) for a, b in more for c, d in edges if b == c} - out
        out |= more
    return out


def loaded(spark, step, **kw):
    p = Program(spark, **kw)
    p.execute(f"{REACH} {step}")
    return p


@pytest.mark.parametrize("step", sorted(STEPS))
@pytest.mark.parametrize("most_pairs", [10_000, 3])
def test_closure_of_random_pairs_added_in_turns(spark, step, most_pairs):
    rng = np.random.default_rng(5)
    p, there = loaded(spark, STEPS[step], most_pairs=most_pairs), set()
    for n in (12, 6, 9):
        some = {(int(a), int(b)) for a, b in rng.integers(0, 22, (n, 2))}
        there |= some
        p.load("edge", spark.createDataFrame(sorted(some), "a long, b long"))
        p.run()
        got = [tuple(r) for r in p.table("path").select("c0", "c1").collect()]
        assert len(got) == len(set(got)) == p.size("path") and set(got) == closed(there)
    assert p.run().rows == 0


def test_a_long_chain_takes_few_iterations(spark):
    for step in STEPS.values():
        p = loaded(spark, step)
        p.load("edge", spark.range(700).selectExpr("id a", "id + 1 b"))
        assert p.run().iterations <= 6 and p.size("path") == 700 * 701 // 2


def test_batches_and_slices(spark, monkeypatch):
    from quern.operators import closure

    for name, value in (("CELLS", 90), ("SLICE", 7)):
        monkeypatch.setattr(closure, name, value)
    rng = np.random.default_rng(6)
    edges = closure.Pairs.of(*rng.integers(0, 40, (2, 60)))
    pairs = {(int(edges.nodes[i]), int(edges.nodes[t])) for i in range(len(edges.nodes)) for t in edges.to[edges.first[i] : edges.first[i + 1]]}
    starts = np.array(sorted({a for a, _ in pairs}))
    seeds = [(i, b) for i, s in enumerate(starts) for a, b in sorted(pairs) if a == s]
    found = [(int(starts[s]), int(y)) for x, z in edges.follow(*np.array(seeds).T, np.full(len(seeds), closure.THERE)) for s, y in zip(x, z)]
    assert len(found) == len(set(found)) and set(found) == closed(pairs) - pairs


def test_links_united_in_one_task(spark):
    from quern.operators.components import local_roots, roots, task_roots
    from quern.storage import Workspace

    rng = np.random.default_rng(8)
    links = [(int(a).to_bytes(2, "big"), int(b).to_bytes(2, "big")) for a, b in rng.integers(0, 4_000, (3_000, 2))]
    links += [(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(5_000, 9_000)]
    table = spark.createDataFrame(links, "a binary, b binary").repartition(5)
    want = local_roots(links)
    assert {bytes(r.id): bytes(r.root) for r in task_roots(table).collect()} == want
    for limits in ((100_000, 100_000), (0, 100_000), (0, 0)):
        got, n, least = roots(table, Workspace(spark), *limits)
        assert {bytes(r.id): bytes(r.root) for r in got.collect()} == want and n == len(want) and least == min(want)


def test_ids_are_short(spark):
    """Ids go through every shuffle, so they are 16 bytes; a table of links beyond the driver's goes to one task."""
    p = Program(spark, driver_links=0)
    p.execute("(sort Node) (function node (i64) Node) (relation link (i64 i64)) (rule ((link x y)) ((union (node x) (node y))))")
    p.load("link", spark.range(300).selectExpr("id a", "id + 1 b"))
    p.run()
    rows = p.table("node").collect()
    assert len(rows) == 301 and {len(r["out"]) for r in rows} == {16} and len({bytes(r["out"]) for r in rows}) == 1


def test_renamed_outputs_are_put_back_without_a_merge(spark):
    """Where ids are only outputs, a rename gives no contributions: the rows it wrote are the table's."""
    p = Program(spark)
    p.execute("(sort Node) (function node (i64) Node) (function of (String) Node) (node 1) (node 2) (of \"a\")")
    old = {r["c0"]: r["out"] for r in p.table("node").collect()}
    dirty = spark.createDataFrame([(old[2], old[1])], "id binary, root binary")
    assert p.tables["node"].rename(dirty, "Node", p.epoch, False, True) is None
    assert {r["c0"]: r["out"] for r in p.table("node").collect()} == {1: old[1], 2: old[1]} and p.size("node") == 2
    assert p.tables["of"].rename(dirty, "Node", p.epoch, False, True) is None and p.size("of") == 1
