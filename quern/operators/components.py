"""Union-find over links: on the driver for few of them, in one task for some millions, else as a distributed loop of joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import BROADCAST_ROWS as _WIDE, Workspace

#: Ids are as long as a digest, so fewer of them are broadcast than of numbers.
BROADCAST_ROWS = _WIDE // 4

#: Links that the driver may hold; more are worked on by Spark.
DRIVER_LINKS = 100_000
#: Links that one task may hold: two ids of 16 bytes and two numbers each, under 1 GB in all.
TASK_LINKS = 8_000_000
#: A node with more links than this is joined apart from the others, so that no task gets all of its links.
HOT_LINKS = 1_000


def local_roots(links: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Each linked id that is not the least of its class, with the least."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: r for x in list(parent) if (r := find(x)) != x}


def _with_least(near: DataFrame, space: Workspace, hot_links: int) -> DataFrame:
    """near (u, v) with m, the least of u and all its v.

    The minimum is pre-aggregated before its shuffle. Nodes of over hot_links links meet
    theirs in a broadcast, so their links stay where they are; there are at most
    links / hot_links of them, and that number is checked: the bound goes up until they fit.
    """
    least, facts = space.measured(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least", hot=F.col("n") > hot_links)
    if facts["n"] <= BROADCAST_ROWS:
        return near.join(F.broadcast(least.select("u", "m")), "u")
    if not facts["hot"]:
        return near.join(least.select("u", "m"), "u")
    while facts["hot"] > BROADCAST_ROWS:
        hot_links *= 10
        facts["hot"] = least.where(F.col("n") > hot_links).count()
    hot = F.broadcast(least.where(F.col("n") > hot_links).select("u", "m"))
    cool = near.join(F.broadcast(least.where(F.col("n") > hot_links).select("u")), "u", "left_anti").join(least.where(F.col("n") <= hot_links).select("u", "m"), "u")
    return near.join(hot, "u").unionByName(cool)


def distributed_roots(links: DataFrame, space: Workspace, hot_links: int = HOT_LINKS) -> DataFrame:
    """(id, root) as local_roots for links (a, b) of any ordered type, by alternating large-star and small-star steps on tables of links.

    Links to itself and repeated links are ignored; rows with nulls are dropped. No
    links, no rows. The driver sees only whether all links are stars; that is asked by
    one pre-aggregated count by node, so no round is spent on seeing that nothing changes.
    """

    def large(edges: DataFrame) -> DataFrame:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        return _with_least(near, space, hot_links).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))

    def small(edges: DataFrame) -> DataFrame:
        near = _with_least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), space, hot_links)
        return near.select(F.col("m").alias("a"), F.explode(F.array("v", "u")).alias("b")).where("a <> b")

    def stars(edges: DataFrame) -> bool:
        """Whether each node is either a centre or on one link as its end."""
        places = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("held")), F.struct(F.col("b").alias("node"), F.lit(1).alias("held")))
        ends = edges.select(F.explode(places).alias("x")).groupBy("x.node").agg(F.min("x.held").alias("least"), F.sum("x.held").alias("n"))
        return ends.where("n > 1 or n = 1 and least = 0").isEmpty()

    edges = space.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    while not stars(edges):
        edges = space.save(small(space.save(large(edges).distinct(), "stars")).distinct(), "stars")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))


def joined_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the class of each of n nodes under links (a, b): labels go to the lesser of two linked ones and on to their own label, until links are within classes."""
    label = np.arange(n)
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, b, a)
        while (label != (up := label[label])).any():
            label = up
    return label


def task_roots(links: DataFrame) -> DataFrame:
    """(id, root) as distributed_roots, with all links in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids = pa.concat_arrays([*table["a"].chunks, *table["b"].chunks]).dictionary_encode()
        order = ids.dictionary.take(order_by := pc.sort_indices(ids.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order_by.to_numpy()] = np.arange(len(order))
        ends = rank[ids.indices.to_numpy()]
        label = joined_roots(ends[: len(ends) // 2], ends[len(ends) // 2 :], len(order))
        moved = np.flatnonzero(label != np.arange(len(label)))
        for at in range(0, len(moved), 1 << 18):
            some = moved[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([order.take(pa.array(some)), order.take(pa.array(label[some]))], names=["id", "root"])

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(run, f"id {kind}, root {kind}")


def roots(links: DataFrame, space: Workspace, driver_links: int = DRIVER_LINKS, task_links: int = TASK_LINKS) -> tuple[DataFrame, int, bytes]:
    """(id, root) of links (a, b) between ids, how many ids have another root, and the least such id. Ties: the least id is the root."""
    some = links.limit(driver_links + 1).collect()
    if len(some) <= driver_links:
        found = sorted(local_roots((bytes(r[0]), bytes(r[1])) for r in some).items())
        ids = [x for x, _ in found]
        table = pa.table({"id": pa.array(ids, pa.binary()), "root": pa.array([r for _, r in found], pa.binary())})
        return space.spark.createDataFrame(table), len(found), min(ids, default=b"")
    links, facts = space.measured(links, "linked")
    if facts["n"] <= task_links:
        table, facts = space.measured(task_roots(links), "united")
        return table, facts["n"], bytes(table.agg(F.min("id")).first()[0] or b"")
    table = distributed_roots(links, space)
    n, least = table.agg(F.count("*"), F.min("id")).first()
    return table, n, bytes(least or b"")
