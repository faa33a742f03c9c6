"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r. Rates meet a target of tokens for each source and otherwise
stay as near as they can to taking every document once: they minimise the sum over
documents of r log r - r + 1 with 0 <= r <= cap. The dual has one multiplier per source,
and rates are tilted exponentially by what a document weighs in its source's constraint:
r = min(cap, exp(multiplier * size / mean size)). So a source that is cut gives up long
documents first, whose tokens cost most in the constraint, and one that is stretched
doubles them first.

The dual is solved by Newton steps on the logarithm of the tokens that a source gets,
kept inside a bracket, for all sources at once: one distributed aggregation a step over
cells (source, size) that a first pass has summed up. Multipliers stay in a table, so
sources may be many.

Rates are then rounded to copies. The cells of a source are gone through from large to
small sizes, each handing on what rounding left over, so that a source ends within a few
words of its target; a cell's copies go by a seeded order of its documents. A cell of over
CELL_ROWS documents is split by row, and its copies in proportion, so no task holds a hot one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import forget, free_name, keyed, materialize, small
from quern.storage import BROADCAST_ROWS, Workspace

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CELL_ROWS = 500
ROUNDS, TOLERANCE = 100, 1e-9


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """sizes (source, source_size and more, a row per source) with target: sources by code point, null last, weigh `weights`, repeating, and share share * all; none gets over cap times its own, the excess going to the others by weight.

    Sources by what they can take for their weight: those in front are full as long as what is left, shared by
    weight among the rest, is more than that. The windows sort one row per source, not documents.
    """
    known = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", F.element_at(known, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * float(cap)).withColumn("level", F.col("most") / F.col("weight"))
    by = Window.orderBy("level", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weighed = weighed.withColumn("shared", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.struct("level", F.col("source").isNull().alias("last"), "source", "shared")
    shared = F.min(F.when(F.col("shared") <= F.col("level"), first)).over(every)["shared"]
    target = F.least(F.coalesce(F.col("weight") * shared, F.col("most")), F.col("most"))
    return weighed.withColumn("target", F.greatest(target, F.lit(0.0))).drop("weight", "most", "level", "shared")


def _rate(cap: float) -> Column:
    """The rate of a document of `size` words from its source's facts."""
    tilted = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("full"), F.lit(float(cap))).otherwise(tilted)


def balance(cells: DataFrame, facts: DataFrame, cap: float = 2.0, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """facts (source, source_size, target, n_docs, a row per source) with mean, full and tilt, the multiplier at which the rates of cells (source, size, n) meet the target to a part of tolerance.

    A source at its cap is full: no finite multiplier gives that. Raises if a step limit is reached.
    """
    none = F.lit(None).cast("double")
    state = facts.withColumns({"mean": F.try_divide("source_size", "n_docs"), "full": F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12), "tilt": F.lit(0.0), "lo": none, "hi": none, "off": F.lit(1.0)})
    with Workspace(cells.sparkSession) as space:
        state, seen = space.measured(state, "tilts", open=(F.col("target") > 0) & ~F.col("full"))
        for _ in range(rounds):
            if not seen["open"]:
                return materialize(state.drop("lo", "hi", "off"), "tilts")
            side = state.where("target > 0 and not full and off > " + repr(tolerance)).select(F.col("source").alias("s"), "tilt", "mean", "target", "full")
            side = F.broadcast(side) if seen["n"] <= BROADCAST_ROWS else side
            rate = _rate(cap)
            got = cells.join(side, F.col("source").eqNullSafe(F.col("s"))).select("s", (F.col("n") * F.col("size") * rate).alias("r"), F.when(rate < cap, F.col("size") / F.col("mean")).otherwise(0.0).alias("f"))
            got = got.groupBy("s").agg(F.sum("r").alias("g"), F.sum(F.col("r") * F.col("f")).alias("h"))
            new = state.join(got, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
            few = F.col("g") < F.col("target")
            new = new.withColumns({"off": F.coalesce(F.abs(F.try_divide("g", "target") - 1), "off"), "lo": F.when(few, F.col("tilt")).otherwise(F.col("lo")), "hi": F.when(F.col("g") > F.col("target"), F.col("tilt")).otherwise(F.col("hi"))})
            step = F.col("tilt") + F.ln(F.try_divide("target", "g")) * F.try_divide("g", "h")
            inside = (step > F.coalesce("lo", F.lit(-math.inf))) & (step < F.coalesce("hi", F.lit(math.inf)))
            wide = F.when(few, F.greatest(F.col("tilt") * 2, F.col("tilt") + 1)).otherwise(F.least(F.col("tilt") * 2, F.col("tilt") - 1))
            step = F.when(inside, step).otherwise(F.coalesce((F.col("lo") + F.col("hi")) / 2, wide))
            new = new.withColumn("tilt", F.when(F.col("g").isNull() | (F.col("off") <= tolerance), F.col("tilt")).otherwise(step)).drop("g", "h")
            state, seen = space.measured(new, "tilts", open=(F.col("target") > 0) & ~F.col("full") & (F.col("off") > tolerance))
    raise RuntimeError(f"targets were not met in {rounds} steps")


def _diffuse(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for each cell of a source: rate * rows, rounded to meet the tokens that larger sizes left over."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    copies, left = [], 0.0
    for size, n, rate, cap in zip(cells["size"], cells["n"], cells["rate"], cells["cap"], strict=True):
        want = rate * n * size + left
        k = int(min(max(math.floor(want / size + 0.5), 0), math.floor(cap) * n))
        left = want - k * size
        copies.append(k)
    return cells.assign(copies=np.array(copies, np.int64))[["source", "size", "copies"]]


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0, seed: int = 11, cell_rows: int = CELL_ROWS, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken[, key]) for each row of docs (doc_id, text, source).

    size counts the words of the whole text (null, or no word: 0, and no copies);
    copies is at most cap. A null source is a source of its own, the last. Rows with
    the same doc_id, or without one, are separate rows, told apart by key, or one made here if it isn't
    given. Equal files give equal output. No rows, no rows. Other columns are not looked at.
    """
    given = key is not None
    if not given:
        docs, key = keyed(docs)
    sized = materialize(docs.select("doc_id", F.col(key).alias("row"), "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")), "sizes")
    cells = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    facts = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    facts = balance(cells, source_targets(facts, share, weights, cap), cap).withColumnRenamed("source", "s")
    side = small(facts)

    same = lambda a, b, *names: [a[c].eqNullSafe(b[c]) for c in names]
    # one group per source of one row per size that its texts have
    live = cells.where("size > 0").join(side, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", _rate(cap).alias("rate"), F.lit(float(cap)).alias("cap"))
    quota = materialize(live.groupBy("source").applyInPandas(_diffuse, "source string, size long, copies long"), "quota")
    split = small(materialize(cells.where(F.col("n") > cell_rows).select("source", "size", F.ceil(F.col("n") / cell_rows).cast("int").alias("salts")), "split"))
    salted = sized.join(split, same(sized, split, "source", "size"), "left").select(sized["*"], F.coalesce(F.pmod(F.xxhash64("row"), split["salts"]), F.lit(0)).alias("salt"))
    salted = materialize(salted, "salted")
    parts = salted.where("size > 0").groupBy("source", "size", "salt").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt"))
    parts = parts.withColumns({"upto": upto, "all": F.sum("m").over(Window.partitionBy("source", "size"))})
    parts = parts.join(small(quota), same(parts, quota, "source", "size")).select(*(parts[c] for c in parts.columns), "copies")
    share_of = lambda upto: F.expr(f"copies * ({upto}) div all")
    parts = materialize(parts.select("source", "size", "salt", "m", (share_of("upto") - share_of("upto - m")).alias("copies")), "parts")
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "row"))
    ranked = salted.withColumn("rank", rank)
    out = ranked.join(small(parts), same(ranked, parts, "source", "size", "salt"), "left").select(ranked["*"], "m", "copies")
    copies = F.coalesce(F.expr("copies div m") + (F.col("rank") <= F.col("copies") % F.col("m")).cast("long"), F.lit(0))
    out = out.withColumn("copies", copies).join(side, F.col("source").eqNullSafe(F.col("s")), "left")
    rate = F.when(F.col("size") > 0, _rate(cap)).otherwise(0.0)
    out = out.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"), F.col("row").alias(key))
    forget(sized, cells, quota)
    return out if given else out.drop(key)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it; other cases as for mix(). All columns of docs stay as they are."""
    columns = docs.columns
    docs, key = keyed(docs)
    n = free_name("_copies", docs)
    mixed = materialize(mix(docs, key=key, **options).where("copies > 0").select(key, F.col("copies").alias(n)), "mixed")
    out = docs.join(small(mixed, BROADCAST_ROWS // 4), key)
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*[out[c] for c in columns])
