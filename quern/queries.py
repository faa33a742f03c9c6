"""Queries over the standard tables, one or more for each operator of the engine, and the SQL that says what they must give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.errors import ProgramError
from quern.program import Program
from quern.sources.programs import cents, read_table, units

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(sql: str | None) -> Callable[[QueryFunction], QueryFunction]:
    def add(f: QueryFunction) -> QueryFunction:
        REGISTRY[f.__name__] = Entry(f, sql)
        return f

    return add


# Inputs. Graph 1: chains of customers, deep and free of cycles. Graph 2: weighted nations, with cycles.


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.lead("c_custkey").over(w).alias("b")).where("b is not null")


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    edges = n.select(F.col("n").alias("a"), ((F.col("n") + 1) % 25).alias("b"), (5 + F.col("n") % 3).alias("w"))
    edges = edges.union(n.select(F.col("n").alias("a"), ((7 * F.col("n") + 3) % 25).alias("b"), (20 + F.col("r")).alias("w")))
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


CHAINS_SQL = "e AS (SELECT * FROM (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL)"
WEIGHTED_SQL = (
    "e AS (SELECT a, b, min(w) AS w FROM (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey + 1) % 25 AS BIGINT) AS b, CAST(5 + n_nationkey % 3 AS BIGINT) AS w FROM nation "
    "UNION ALL SELECT n_nationkey, (7 * n_nationkey + 3) % 25, 20 + n_regionkey FROM nation) GROUP BY a, b)"
)
REACH_SQL = "WITH RECURSIVE {edges}, p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p"


def program(spark: SparkSession, sf_dir: str, text: str, **facts: DataFrame) -> Program:
    """A program with the declarations of text and its relations loaded from DataFrames."""
    p = Program(spark)
    p.execute(text)
    for name, df in facts.items():
        p.load(name, df)
    return p


# Scans, filters, projections


@query("SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def scan_relation(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return program(spark, sf_dir, "(relation nation (i64 i64))", nation=nation).table("nation").select(F.col("c0").alias("nation"), F.col("c1").alias("region"))


def _customers(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT DISTINCT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'FURNITURE'")
def const_filter_input(spark, sf_dir):
    p = program(spark, sf_dir, "(relation customer (i64 i64 String))", customer=_customers(spark, sf_dir))
    return p.query('(customer c n "FURNITURE")')


@query("SELECT DISTINCT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'FURNITURE'")
def const_filter_output(spark, sf_dir):
    p = program(spark, sf_dir, "(function segment (i64 i64) String)", segment=_customers(spark, sf_dir))
    return p.query('(= (segment c n) "FURNITURE")')


@query("SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey")
def repeated_var(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return program(spark, sf_dir, "(relation item (i64 i64 i64 i64))", item=items).query("(item o line k k)")


@query("SELECT DISTINCT o_orderkey AS o, c_custkey AS c FROM orders JOIN customer ON o_custkey + 1 = c_custkey")
def computed_body(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = program(spark, sf_dir, "(relation orders (i64 i64)) (relation customer (i64 i64 String))", orders=orders, customer=_customers(spark, sf_dir))
    return p.query("(orders o x) (= c (+ x 1)) (customer c n s)", ["o", "c"])


@query("SELECT c_custkey AS c, greatest(0, least(CAST(c_nationkey AS BIGINT), 7)) AS m, CAST(c_nationkey AS BIGINT) * c_custkey + 3 AS v FROM customer")
def scalar_functions(spark, sf_dir):
    p = program(spark, sf_dir, "(relation customer (i64 i64 String)) (function f (i64) i64) (function g (i64) i64) (rule ((customer c n s)) ((set (f c) (min n 7)) (set (g c) (+ 3 (* n c (*) (min 1)) (+)))))", customer=_customers(spark, sf_dir))
    p.run()
    return p.query("(= (f c) m) (= (g c) v)")


@query("SELECT o_orderkey AS o, least(o_custkey, o_orderkey, 500) AS m FROM orders")
def min_builtin(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return program(spark, sf_dir, "(relation orders (i64 i64))", orders=orders).query("(orders o x) (= m (min x o 500))", ["o", "m"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS a FROM nation WHERE 1 = 1 AND n_regionkey = 2")
def const_predicate(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    p = program(spark, sf_dir, "(relation nation (i64 i64))", nation=nation)
    return p.query("(= (+ 1 1) 2) (nation a 2)").unionAll(p.query("(= 1 2) (nation a r)", ["a"]))


# Joins and sets


@query("SELECT c_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join2(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = program(spark, sf_dir, "(relation orders (i64 i64)) (relation customer (i64 i64 String))", orders=orders, customer=_customers(spark, sf_dir))
    return p.query('(orders o c) (customer c n "BUILDING")', ["c", "o"])


@query("SELECT r_name AS r, n_name AS n, c_custkey AS c, o_orderkey AS o FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def join4(spark, sf_dir):
    p = program(
        spark,
        sf_dir,
        "(relation region (i64 String)) (relation nation (i64 String i64)) (relation customer (i64 i64 String)) (relation orders (i64 i64))",
        region=read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
        nation=read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        customer=_customers(spark, sf_dir),
        orders=read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
    )
    return p.query("(region rk r) (nation nk n rk) (customer c nk s) (orders o c)", ["r", "n", "c", "o"])


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def self_join(spark, sf_dir):
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return program(spark, sf_dir, "(relation supplier (i64 i64))", supplier=suppliers).query("(supplier a n) (supplier b n)", ["a", "b"])


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def product_of_regions(spark, sf_dir):
    region = read_table(spark, sf_dir, "region").select("r_name")
    return program(spark, sf_dir, "(relation region (String))", region=region).query("(region a) (region b)")


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT p_partkey FROM part")
def intersect(spark, sf_dir):
    p = program(spark, sf_dir, "(relation a (i64)) (relation b (i64))", a=read_table(spark, sf_dir, "customer").select("c_custkey"), b=read_table(spark, sf_dir, "part").select("p_partkey"))
    return p.query("(a k) (b k)")


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_orderkey FROM orders")
def union_rules(spark, sf_dir):
    p = program(spark, sf_dir, "(relation a (i64)) (relation b (i64)) (relation u (i64)) (rule ((a x)) ((u x))) (rule ((b x)) ((u x)))", a=read_table(spark, sf_dir, "customer").select("c_custkey"), b=read_table(spark, sf_dir, "orders").select("o_orderkey"))
    p.run()
    return p.table("u").select(F.col("c0").alias("k"))


@query("SELECT r_name AS r, EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_mktsegment = 'MACHINERY') AS found FROM region")
def semi_join_check(spark, sf_dir):
    p = program(spark, sf_dir, "(relation nation (i64 i64)) (relation customer (i64 i64 String))", nation=read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), customer=_customers(spark, sf_dir))
    regions = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    return spark.createDataFrame([(r.r_name, p.check(f'(nation n {r.r_regionkey}) (customer c n "MACHINERY")')) for r in regions], "r string, found boolean")


# Merges


def _merged(spark, df, merge, order_by=None):
    p = Program(spark)
    p.function("f", ["i64"], "i64", merge)
    p.load("f", df, df.columns[:2], order_by)
    return p.table("f").select(F.col("c0").alias("k"), F.col("out").alias("v"))


def _lines(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem")


@query("SELECT l_partkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def merge_sum(spark, sf_dir):
    return _merged(spark, _lines(spark, sf_dir).select("l_partkey", units("l_quantity").alias("q")), "(+ old new)")


@query("SELECT l_orderkey AS k, CAST(product(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def merge_product(spark, sf_dir):
    return _merged(spark, _lines(spark, sf_dir).select("l_orderkey", "l_linenumber"), "(* old new)")


@query("SELECT c_custkey % 1000 AS k, min(CAST(round(c_acctbal * 100) AS BIGINT)) AS v FROM customer GROUP BY 1")
def merge_min_group(spark, sf_dir):
    return _merged(spark, read_table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("k"), cents("c_acctbal").alias("v")), "(min old new)")


@query("SELECT o_custkey AS k, arg_min(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) AS v FROM orders GROUP BY 1")
def merge_first(spark, sf_dir):
    return _merged(spark, read_table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("v"), "o_orderkey"), "old", ["o_orderkey"])


@query("SELECT o_custkey AS k, arg_max(CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) AS v FROM orders GROUP BY 1")
def merge_last(spark, sf_dir):
    return _merged(spark, read_table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("v"), "o_orderkey"), "new", ["o_orderkey"])


@query("SELECT o_custkey AS k, CAST(list_reduce(list(o_orderkey ORDER BY o_orderkey), lambda a, b: least(2 * a + b, 1000000)) AS BIGINT) AS v FROM orders GROUP BY 1")
def merge_fold(spark, sf_dir):
    return _merged(spark, read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("v"), "o_orderkey"), "(min (+ (* 2 old) new) 1000000)", ["o_orderkey"])


@query("SELECT c_nationkey AS k, CAST(sum(n) AS BIGINT) AS v FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_nationkey + 1 AS BIGINT) AS n FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY 1")
def bag_projection(spark, sf_dir):
    """Each binding of a rule counts for a sum, also those that differ only in what the head leaves out."""
    p = program(
        spark,
        sf_dir,
        "(relation orders (i64 i64)) (relation customer (i64 i64 String)) (function total (i64) i64 :merge (+ old new)) (rule ((orders o c) (customer c n s)) ((set (total n) (+ n 1))))",
        orders=read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        customer=_customers(spark, sf_dir),
    )
    p.run()
    return p.table("total").select(F.col("c0").alias("k"), F.col("out").alias("v"))


@query("SELECT CAST(min(n_nationkey) AS VARCHAR) || ' != ' || CAST(max(n_nationkey) AS VARCHAR) || ' in first' AS error, CAST(0 AS BIGINT) AS size FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation)")
def conflict_error(spark, sf_dir):
    """Outputs of a function without a merge must agree: the error names the extremes of the first key that has several, and the table stays as it was."""
    p = program(spark, sf_dir, "(relation nation (i64 i64)) (function first (i64) i64) (rule ((nation n r)) ((set (first r) n)))", nation=read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    try:
        p.run()
    except ProgramError as e:
        return spark.createDataFrame([(str(e), p.size("first"))], "error string, size long")
    raise AssertionError("the conflict went unnoticed")


@query(f"WITH {CHAINS_SQL} SELECT a, b FROM e UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a")
def snapshot_semantics(spark, sf_dir):
    """In one iteration rules see what was there before it: the second rule finds no path in the first iteration, and only edges in the second."""
    return _reach(spark, sf_dir, chains(spark, sf_dir), limit=2)


# Recursion


REACH = "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge x y)) ((path x y)))"


def _reach(spark, sf_dir, edges, step="(rule ((path x y) (edge y z)) ((path x z)))", limit=None):
    p = program(spark, sf_dir, f"{REACH} {step}", edge=edges.select("a", "b"))
    p.run(limit)
    return p.table("path").select(F.col("c0").alias("a"), F.col("c1").alias("b"))


@query(REACH_SQL.format(edges=CHAINS_SQL))
def reach_chains(spark, sf_dir):
    return _reach(spark, sf_dir, chains(spark, sf_dir))


@query(REACH_SQL.format(edges=CHAINS_SQL))
def reach_chains_doubling(spark, sf_dir):
    return _reach(spark, sf_dir, chains(spark, sf_dir), "(rule ((path x y) (path y z)) ((path x z)))")


@query(REACH_SQL.format(edges=WEIGHTED_SQL))
def reach_nations(spark, sf_dir):
    return _reach(spark, sf_dir, weighted(spark, sf_dir))


@query(f"WITH {CHAINS_SQL} SELECT a, b FROM e UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a UNION SELECT x.a, z.b FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a")
def bounded_run(spark, sf_dir):
    return _reach(spark, sf_dir, chains(spark, sf_dir), limit=3)


@query(f"WITH RECURSIVE {WEIGHTED_SQL}, p AS (SELECT a, b, w, 1 AS n FROM e UNION SELECT p.a, e.b, p.w + e.w, p.n + 1 FROM p JOIN e ON p.b = e.a WHERE p.n < 12), m AS (SELECT a, b, min(w) AS w FROM p GROUP BY a, b) SELECT a, b, CAST(w AS BIGINT) AS w FROM m")
def shortest_path(spark, sf_dir):
    p = program(
        spark,
        sf_dir,
        "(function edge (i64 i64) i64) (function path (i64 i64) i64 :merge (min old new)) (rule ((= (edge x y) w)) ((set (path x y) w))) (rule ((= (path x y) v) (= (edge y z) w)) ((set (path x z) (+ v w))))",
        edge=weighted(spark, sf_dir),
    )
    p.run()
    return p.table("path").select(F.col("c0").alias("a"), F.col("c1").alias("b"), F.col("out").alias("w"))


@query(REACH_SQL.format(edges=CHAINS_SQL))
def incremental_run(spark, sf_dir):
    edges = chains(spark, sf_dir)
    p = program(spark, sf_dir, f"{REACH} (rule ((path x y) (path y z)) ((path x z)))", edge=edges.where("a % 2 = 0"))
    p.run()
    p.load("edge", edges.where("a % 2 = 1"))
    p.run()
    return p.table("path").select(F.col("c0").alias("a"), F.col("c1").alias("b"))


@query(f"WITH RECURSIVE {CHAINS_SQL}, s AS (SELECT min(c_custkey) AS a FROM customer GROUP BY c_nationkey, c_mktsegment), p AS (SELECT a, b FROM e WHERE a IN (SELECT a FROM s) UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p")
def reach_from_start(spark, sf_dir):
    """What the first customer of every chain reaches."""
    p = program(
        spark,
        sf_dir,
        "(relation edge (i64 i64)) (relation start (i64)) (relation path (i64 i64)) (rule ((start x) (edge x y)) ((path x y))) (rule ((path x y) (edge y z)) ((path x z)))",
        edge=chains(spark, sf_dir),
        start=read_table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c")).select("c"),
    )
    p.run()
    return p.table("path").select(F.col("c0").alias("a"), F.col("c1").alias("b"))


# Sorts, unions, congruence


@query("SELECT c_custkey AS c, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS least FROM customer")
def components(spark, sf_dir):
    p = program(
        spark,
        sf_dir,
        "(sort Node) (function node (i64) Node) (relation link (i64 i64)) (relation own (i64)) (rule ((own x)) ((node x))) (rule ((link x y)) ((union (node x) (node y))))",
        link=chains(spark, sf_dir),
        own=read_table(spark, sf_dir, "customer").select("c_custkey"),
    )
    p.run()
    node = p.table("node")
    return node.select(F.col("c0").alias("c"), F.min("c0").over(Window.partitionBy("out")).alias("least"))


@query("SELECT c_custkey AS c, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS least FROM customer")
def components_by_stars(spark, sf_dir):
    """As components, with links united by distributed star contraction, as they are where the driver can't hold them."""
    p = Program(spark, driver_links=0, task_links=0)
    p.execute("(sort Node) (function node (i64) Node) (relation link (i64 i64)) (relation own (i64)) (rule ((own x)) ((node x))) (rule ((link x y)) ((union (node x) (node y))))")
    p.load("link", chains(spark, sf_dir))
    p.load("own", read_table(spark, sf_dir, "customer").select("c_custkey"))
    p.run()
    node = p.table("node")
    # the least of each class by aggregation and join: a window would take a class in one task
    least = node.groupBy("out").agg(F.min("c0").alias("least"))
    return node.join(least, "out").select(F.col("c0").alias("c"), "least")


@query("SELECT doc_id AS d, min(doc_id) OVER (PARTITION BY text) AS least FROM documents")
def equal_documents(spark, sf_dir):
    """Documents with the same text are one: two functions of the same key meet in a rule."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    p = program(spark, sf_dir, "(sort Text) (relation doc (i64 String)) (function of (i64) Text) (function text (String) Text) (rule ((doc d t)) ((union (of d) (text t))))", doc=docs)
    p.run()
    return p.query("(= (of d) s)").select("d", F.min("d").over(Window.partitionBy("s")).alias("least"))


@query(
    f"WITH RECURSIVE {CHAINS_SQL}, r AS (SELECT c_custkey AS c, CAST(c_nationkey AS BIGINT) AS n FROM customer), q AS (SELECT DISTINCT x.n AS a, y.n + 0 AS b FROM orders JOIN r x ON x.c = o_custkey JOIN r y ON y.c = o_custkey + 1), "
    "p AS (SELECT a, b FROM q UNION SELECT p.a, q.b FROM p JOIN q ON p.b = q.a) SELECT a, b FROM p"
)
def reach_after_union(spark, sf_dir):
    """Customers are nodes; those of one nation are made one, and reachability is asked of the classes."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") + 1).alias("next"))
    p = program(
        spark,
        sf_dir,
        """(sort Node) (function node (i64) Node) (function nation (i64) Node) (relation step (i64 i64)) (relation lives (i64 i64))
        (relation edge (Node Node)) (relation path (Node Node))
        (rule ((lives c n)) ((union (node c) (nation n))))
        (rule ((step a b) (lives a n) (lives b m)) ((edge (node a) (node b))))
        (rule ((edge x y)) ((path x y)))
        (rule ((path x y) (edge y z)) ((path x z)))""",
        step=orders,
        lives=read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
    )
    p.run()
    return p.query("(path x y) (= (nation a) x) (= (nation b) y)", ["a", "b"])


@query("SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON a.p_brand = b.p_brand GROUP BY 1")
def congruence(spark, sf_dir):
    """Parts of one brand are made one, and so are the terms over them, two levels up."""
    p = program(
        spark,
        sf_dir,
        "(datatype Term (Part i64) (Box Term) (Pair Term Term)) (relation brand (i64 i64)) (relation part (i64)) (rule ((part x)) ((Pair (Box (Part x)) (Box (Box (Part x)))))) (rule ((brand x y)) ((union (Part x) (Part y))))",
        brand=read_table(spark, sf_dir, "part").select(F.min("p_partkey").over(Window.partitionBy("p_brand")).alias("least"), "p_partkey"),
        part=read_table(spark, sf_dir, "part").select("p_partkey"),
    )
    p.run()
    same = p.query("(= (Part x) t) (= (Pair (Box t) (Box (Box t))) q)", ["x", "q"])
    return same.select(F.col("x").alias("a"), F.min("x").over(Window.partitionBy("q")).alias("b"))


@query("SELECT CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations, CAST(count(DISTINCT (c_nationkey, c_mktsegment)) AS BIGINT) AS segments FROM customer")
def get_or_create(spark, sf_dir):
    p = program(spark, sf_dir, "(datatype Place (Nation i64) (Segment Place String)) (relation customer (i64 i64 String)) (rule ((customer c n s)) ((Segment (Nation n) s)))", customer=_customers(spark, sf_dir))
    p.run()
    return spark.createDataFrame([(p.size("Nation"), p.size("Segment"))], "nations long, segments long")


MATH = "(datatype Math (Num i64) (Var String) (Add Math Math) (Mul Math Math))"


@query("SELECT p_partkey AS k, p_partkey + p_size + p_size * 3 AS v FROM part")
def eqsat_arithmetic(spark, sf_dir):
    p = program(
        spark,
        sf_dir,
        f"{MATH} (relation part (i64 i64)) (function term (i64) Math) (rule ((part k s)) ((set (term k) (Add (Add (Num k) (Num s)) (Mul (Num s) (Num 3))))))"
        "(rewrite (Add (Num a) (Num b)) (Num (+ a b))) (rewrite (Mul (Num a) (Num b)) (Num (* a b)))",
        part=read_table(spark, sf_dir, "part").select("p_partkey", "p_size"),
    )
    p.run()
    return p.query("(= (term k) (Num v))")


@query("SELECT p_partkey AS k FROM part")
def eqsat_check_pairs(spark, sf_dir):
    """k * (x + 3) and 3 * k + k * x are proved equal for every part asked about."""
    p = program(
        spark,
        sf_dir,
        f"{MATH} (relation part (i64)) (function left (i64) Math) (function right (i64) Math)"
        '(rule ((part k)) ((set (left k) (Mul (Num k) (Add (Var "x") (Num 3)))) (set (right k) (Add (Num (* 3 k)) (Mul (Num k) (Var "x"))))))'
        "(rewrite (Add a b) (Add b a)) (rewrite (Mul a (Add b c)) (Add (Mul a b) (Mul a c))) (rewrite (Mul (Num a) (Num b)) (Num (* a b)))",
        part=read_table(spark, sf_dir, "part").select("p_partkey"),
    )
    p.run()
    return p.query("(= (left k) t) (= (right k) t)", ["k"])


@query("SELECT 'lives' AS name, CAST(count(*) AS INT) AS n FROM customer UNION ALL SELECT 'home', CAST(count(DISTINCT c_nationkey) AS INT) FROM customer UNION ALL SELECT 'limit', 1")
def print_size(spark, sf_dir):
    p = program(spark, sf_dir, "(relation lives (i64 i64)) (relation home (i64)) (rule ((lives c n)) ((home n)))", lives=read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    lines = p.execute("(let limit (* 6 9)) (run) (print-size lives) (print-size home) (print-size limit)")
    return spark.createDataFrame([(x.split()[1], int(x.split()[-1])) for x in lines], "name string, n int")


@query("SELECT 'nation' AS name, count(*) AS size FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_sizes(spark, sf_dir):
    read = lambda name, key: read_table(spark, sf_dir, name).select(key)
    p = program(spark, sf_dir, "(relation nation (i64)) (relation orders (i64)) (relation part (i64))", nation=read("nation", "n_nationkey"), orders=read("orders", "o_orderkey"), part=read("part", "p_partkey"))
    return p.sizes()


@query("SELECT c_custkey AS c, c_custkey + 42 AS v FROM customer WHERE c_nationkey = 7")
def let_global(spark, sf_dir):
    p = program(spark, sf_dir, "(relation customer (i64 i64 String)) (let offset (+ 40 2)) (let home 7)", customer=_customers(spark, sf_dir))
    return p.query("(= (home) n) (customer c n s) (= v (+ c (offset)))", ["c", "v"])


@query("SELECT o_orderkey AS o, CAST(c_nationkey AS BIGINT) + 1 AS v FROM orders JOIN customer ON c_custkey = o_custkey")
def lookup_in_head(spark, sf_dir):
    p = program(
        spark,
        sf_dir,
        "(relation orders (i64 i64)) (function home (i64) i64) (function found (i64) i64) (rule ((orders o c)) ((set (found o) (+ 1 (home c)))))",
        orders=read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        home=read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
    )
    p.run()
    return p.table("found").select(F.col("c0").alias("o"), F.col("out").alias("v"))
