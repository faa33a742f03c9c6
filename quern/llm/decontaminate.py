"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

Words are runs of letters and digits, lower-cased; shingles are five of them (a
shorter item is one shingle). For each number of words that items have, every window of as
many words is taken that has enough shingles of such items, wherever they stand in it: a
similarity of SIMILARITY needs that many in common, so none that could count is left out.

A window's SimHash has 256 bits in BLOCKS blocks of 16. Two fingerprints within RADIUS =
BLOCKS * (FLIPS + 1) - 1 bits differ by FLIPS bits at most in one block at least. So
windows and items of a size meet under (block, value), an item being posted under all
values within FLIPS bits of its own (697 a block; a random pair meets with a chance of
one in six). Pairs are held to RADIUS by the bits that differ and then verified exactly:
the similarity of a window and an item is the sum of the lesser over the sum of the
greater of each shingle's number of occurrences, and SIMILARITY is enough. At 0.8 a bit
differs with a chance of 0.15, so 39 bits do on average with a deviation of 5.7; RADIUS
lies 4.2 deviations above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import forget, keyed, materialize, small

WIDTH = 5
BLOCKS, BLOCK_BITS, FLIPS = 16, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
SIMILARITY = 0.8
#: Shingles of items that are broadcast, as one long each; with more, the corpus' shingles are shuffled to them, and adaptive skew joins split what is common.
SEED_ROWS = 4_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(width: int) -> Column:
    """The shingle hashes of the column w, in order, each of width words; shingles of different widths have hashes of their own."""
    words = ", ".join(f"w[i + {j}]" for j in range(width))
    return F.expr(f"case when size(w) >= {width} then transform(sequence(0, size(w) - {width}), i -> xxhash64({words}, {width})) else cast(array() as array<bigint>) end")


def _simhash(column: str) -> Column:
    """The fingerprint of an array of shingles, as an array of BLOCKS numbers of 16 bits.

    A shingle votes with the 256 bits of its four hashes. Votes for four bits at a time
    are counted in the four 16-bit lanes of a long, so windows have under 65,536 shingles.
    """
    spread = "(((shiftrightunsigned(y, 4 * r) & 15L) * 35185445863425L) & 281479271743489L)"  # bit i of four goes to bit 16 * i
    lanes = "aggregate(h, 0L, (a, y) -> a + " + spread + ")"
    more = lambda i: f"if((shiftrightunsigned(v, {16 * i}) & 65535L) * 2 > size(h), {1 << i}, 0)"
    nibbles = f"transform(transform(sequence(0, 15), r -> {lanes}), v -> {' + '.join(map(more, range(4)))})"
    hashes = f"transform(array(0, 1, 2, 3), q -> transform({column}, x -> xxhash64(x, q)))"
    four = f"flatten(transform({hashes}, h -> {nibbles}))"
    block = "b[4 * j] | shiftleft(b[4 * j + 1], 4) | shiftleft(b[4 * j + 2], 8) | shiftleft(b[4 * j + 3], 12)"
    return F.expr(f"transform(array({four}), b -> transform(sequence(0, {BLOCKS - 1}), j -> {block}))[0]")


def _distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def _repeated(column: str) -> Column:
    """The values that an array holds more than once."""
    return F.expr(f"transform(array(array_sort({column})), s -> array_distinct(filter(s, (x, i) -> i > 0 and s[i - 1] = x)))[0]")


def _similarity(a: str, b: str, a2: str, b2: str) -> Column:
    """Of two arrays of shingles, with occurrences as weights; a2 and b2 hold what they have more than once, the only shingles that are counted one by one."""
    times = lambda s: f"size(filter({s}, y -> y = x))"
    both = f"(size(array_intersect({a}, {b})) + aggregate(array_intersect({a2}, {b2}), 0, (s, x) -> s + least({times(a)}, {times(b)}) - 1))"
    return F.expr(f"cast({both} as double) / (size({a}) + size({b}) - {both})")


def _starts(similarity: float) -> Column:
    """The starts of all windows of n words that can reach the similarity, from the ordered places ps of a text's shingles that items of the size have.

    A window of `a` shingles and an item of m have similarity * (a + m) / (1 + similarity) in common at least. Each
    window is found at the first of ps in it: from behind the place before, and not so early that too few are in reach.
    """
    m, last = "(n - k + 1)", "greatest(0, all - n)"
    a = f"least({m}, all - k + 1)"
    need = f"greatest(1, cast(ceil({similarity!r}D * ({a} + {m}) / (1 + {similarity!r}D) - 1e-9D) as int))"
    lo = f"greatest(coalesce(get(ps, i - 1) + 1, 0), get(ps, i + {need} - 1) - {a} + 1)"
    hi = f"least(ps[i], {last})"
    found = f"if(get(ps, i + {need} - 1) is null or {lo} > {hi}, cast(array() as array<int>), sequence({lo}, {hi}))"
    return F.expr(f"flatten(transform(sequence(0, size(ps) - 1), i -> {found}))")


def _posted(rows: DataFrame, flips: int) -> DataFrame:
    """rows (n, f and more) under (block, value) of each value within `flips` bits of a block of f."""
    rows = rows.select("*", F.posexplode("f").alias("block", "own"))
    if not flips:
        return rows.withColumnRenamed("own", "value")
    masks = F.array(*[F.lit(x) for x in range(1 << BLOCK_BITS) if x.bit_count() <= flips])
    return rows.withColumn("mask", F.explode(masks)).withColumn("value", F.expr("own ^ mask")).drop("own", "mask")


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(n, f, item, distance) of each fingerprint f of windows (n, f) and each of items (item, n, f) within radius bits, by blocks; each pair once."""
    flips = (radius + 1 + BLOCKS - 1) // BLOCKS - 1
    left = _posted(windows.select("n", "f").distinct(), 0)
    right = _posted(items.select("item", "n", F.col("f").alias("of"), "f"), flips).drop("f")
    # postings are thousands for an item, which no estimate knows: they are shuffled, not broadcast
    met = left.join(right.hint("merge"), ["n", "block", "value"]).withColumn("distance", _distance("f", "of")).where(F.col("distance") <= radius)
    return met.select("n", "f", "item", "distance").distinct()


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, key: str | None = None) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity[, key]) for each document of docs (doc_id, text) and item of benchmark (item_id, text) that it holds, by its best window; start counts words from 0.

    A document shorter than an item is one window. Texts that are null or without
    words hold and are nothing. Rows without a doc_id or item_id are looked at like others;
    so rows with the same doc_id, or item_id, give rows of their own. Ties go to the earlier window.
    Clean documents, and so an empty table or benchmark, give no rows. Other columns are not looked at.
    key names a column that tells the rows of docs apart; without it, one is made.
    """
    given = key is not None
    if not given:
        docs, key = keyed(docs)
    docs = docs.select("doc_id", F.col(key).alias("row"), "text")
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("k", F.least(F.col("n"), F.lit(WIDTH)))
    pick = F.lit(None).cast("array<bigint>")
    for width in range(1, WIDTH + 1):
        pick = F.when(F.col("k") == width, _shingles(width)).otherwise(pick)
    items = items.withColumn("g", pick).withColumn("item", F.monotonically_increasing_id())
    items = materialize(items.select("item", "item_id", "n", "k", "g", _simhash("g").alias("f"), _repeated("g").alias("twice")), "items")
    widths = sorted(r[0] for r in items.select("k").distinct().collect())  # five values at most
    if not widths:
        kinds = ", ".join(f"{c} {t}" for c, t in (("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("item_id", benchmark.schema["item_id"].dataType.simpleString())))
        return docs.sparkSession.createDataFrame([], f"{kinds}, start int, n_words int, distance int, similarity double" + (f", `{key}` binary" if given else ""))
    seeds = materialize(items.select("n", F.explode("g").alias("x")).groupBy("x").agg(F.collect_set("n").alias("ns")), "seeds")

    # one scan: a text's words are made once for all widths
    texts = docs.select("row", _words(F.col("text")).alias("w"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.zip_with(_shingles(k), F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), lambda x, p: F.struct(x.alias("x"), p.alias("p"))).alias("gs")) for k in widths])
    every = texts.select("row", F.size("w").alias("all"), F.explode(each).alias("e")).select("row", "all", "e.k", F.explode("e.gs").alias("g")).where("g.x is not null").select("row", "all", "k", "g.x", "g.p")
    places = every.join(small(seeds, SEED_ROWS), "x").select("row", "all", "k", "p", F.explode("ns").alias("n"))
    places = places.groupBy("row", "all", "k", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    places = materialize(places.select("row", "all", "k", F.struct("n", _starts(similarity).alias("starts")).alias("at")).where("size(at.starts) > 0"), "places")

    # the texts that have a place, read again: few, so that their words need not be carried through a shuffle
    lists = materialize(places.groupBy("row").agg(F.collect_list(F.struct("k", "at")).alias("ats")), "lists")
    again = docs.join(small(lists, weight=F.size("ats") + 1), "row").select("doc_id", "row", _words(F.col("text")).alias("w"), F.explode("ats").alias("a")).select("doc_id", "row", "w", "a.k", "a.at.n", "a.at.starts")
    pick = F.lit(None).cast("array<bigint>")
    for width in widths:
        pick = F.when(F.col("k") == width, _shingles(width)).otherwise(pick)
    windows = again.select("doc_id", "row", "k", "n", pick.alias("g"), F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "row", "k", "n", "start", F.expr("slice(g, start + 1, n - k + 1)").alias("g")).where("size(g) > 0")
    windows = materialize(windows.select("*", _simhash("g").alias("f")), "windows")

    met = candidates(windows, items, radius)
    found = windows.join(met, ["n", "f"]).join(items.select("item", "item_id", "k", F.col("g").alias("ig"), F.col("twice").alias("it")), ["item", "k"])
    found = found.withColumn("wt", _repeated("g")).withColumn("similarity", _similarity("g", "ig", "wt", "it"))
    found = found.where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start", F.col("n").alias("n_words"), "distance", "similarity"), F.struct("similarity", -F.col("start")))
    found = found.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), best.alias("b")).select("doc_id", "item_id", "b.*", F.col("row").alias(key))
    found = materialize(found if given else found.drop(key), "contaminated")
    forget(items, seeds, places, lists, windows)
    return found
