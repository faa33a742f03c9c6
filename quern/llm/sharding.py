"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source; a row's fractional rank is
(rank - 1/2) / rows of its source. Sorted by that, every stretch of the order has
the sources in proportion, and the order is cut into shards of equal counts.

Neither ranking sorts a whole source or the whole table in one task: the hash, and
then the fractional rank, is cut into even ranges; ranges are counted, the counts
summed up, and rows ranked within their range. All of that is done on narrow facts;
texts are joined to their places once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import keyed, materialize, small
from quern.storage import Workspace

#: Rows in a range of the ranking, on average, as long as there are no more than _MOST_RANGES.
RANGE_ROWS = 500
_MOST_RANGES = 65_536
#: A range is looked at for an id that very many rows have if it has so many times the rows expected.
HOT_RANGE = 8


def _ranked(rows: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their rank from 1 within the columns `within` by order; the column range, a number from 0, must not fall along it."""
    counts = rows.groupBy(*within, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*within).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = small(materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "ranges"))
    rank = F.row_number().over(Window.partitionBy(*within, "range").orderBy(*order)).cast("long")
    return rows.withColumn("here", rank).join(before, [*within, "range"]).withColumn(name, F.col("before") + F.col("here")).drop("range", "before", "here")


def interleave(facts: DataFrame, shards: int = 24, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """facts (row, doc_id, source, own) with shard int, 0 to shards - 1, and slot long, gapless from 0 in each shard; row tells rows apart, own is carried along.

    Shard sizes differ by one at most. A null source is a source of its own. Rows with the same doc_id, or
    without one, stand in the order of own, then of row. No rows, no rows.
    """
    stratum = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    with Workspace(facts.sparkSession) as space:
        rows, seen = space.measured(facts.select("*", stratum.alias("stratum"), digest.alias("hash")), "shuffled")
        total = seen["n"]
        ranges = min(_MOST_RANGES, total // range_rows + 1)
        head = lambda c: F.floor(F.conv(F.substring(c, 1, 4), 16, 10).cast("long") * ranges / 65_536)
        held, found = space.measured(rows.groupBy(head("hash").alias("range")).count(), "held", hot=F.col("count") > HOT_RANGE * (total // ranges + 1))
        if found["hot"]:
            # ids that very many rows have, or none: their rows are spread by row
            hot = held.where(F.col("count") > HOT_RANGE * (total // ranges + 1)).select("range")
            ids = rows.withColumn("range", head("hash")).join(F.broadcast(hot), "range").groupBy("hash").count().where(F.col("count") > range_rows)
            ids = small(space.save(ids.select("hash", F.lit(True).alias("spread")), "hot"))
            rows = space.save(rows.join(ids, "hash", "left").withColumn("hash", F.when(F.col("spread"), F.md5(F.concat("hash", F.hex("row")))).otherwise(F.col("hash"))).drop("spread"), "spread")
        sizes = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
        order = [F.col("hash"), F.col("doc_id").asc_nulls_first(), F.col("own").asc_nulls_first(), F.col("row")]
        ranked = _ranked(rows.withColumn("range", head("hash")), ["stratum"], order, "rank")
        ranked = ranked.join(small(space.save(sizes, "sizes")), "stratum").withColumn("part", (2 * F.col("rank") - 1) / (2 * F.col("rows"))).drop("rank", "rows")
        ranked = space.save(ranked.select("*", F.lit(0).alias("all"), F.least(F.floor(F.col("part") * ranges), F.lit(ranges - 1)).alias("range")), "ranked")
        placed = _ranked(ranked, ["all"], [F.col("part"), F.col("stratum"), *order], "place")
        at, n = F.col("place") - 1, F.lit(max(total, 1))
        shard = F.expr(f"(place - 1) * {shards} div {max(total, 1)}")
        slot = at - F.ceil(F.col("shard").cast("long") * n / shards)
        return materialize(placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).select(*facts.columns, "shard", "slot"), "placed")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """docs with shard and slot; a column of docs with one of these names gives way to the new one. Cases as for interleave."""
    docs, key = keyed(docs)
    # as many rows as documents: never broadcast, so that work grows evenly with the table
    placed = interleave(_facts(docs, key), shards, seed).select(F.col("row").alias(key), "shard", "slot")
    return docs.drop("shard", "slot").join(placed.hint("merge"), key).drop(key)


def _facts(docs: DataFrame, key: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return docs.select(F.col(key).alias("row"), "doc_id", "source", F.struct(size.alias("size"), F.crc32("text").alias("text_crc32")).alias("own"))


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of docs (doc_id, text, source); a null text has size 8 and crc null. Other columns are not looked at."""
    placed = interleave(_facts(*keyed(docs)), shards, seed)
    return placed.select("doc_id", "own.size", "own.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
