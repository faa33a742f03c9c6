"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals and exact reranking.

Vectors are normalised and go to the list of their nearest coarse centroid; what
is left is coded in SUBSPACES bytes. Lists are as many as a quarter of the root of the
rows, up to MOST_LISTS, which are reached at 4 * 10^9 rows; from TWO_LEVELS on they are found by way of the
nearest of as many coarser centroids as their root. Centroids and code books are fitted on a
sample, the SAMPLE vectors with the least seeded hash, or 16 for each list if that is more, and every vector is indexed. A
query visits its nearest lists, as many as found RECALL of the sample's own
neighbours, and on until it has seen 16 * RERANK rows; in each it ranks all codes by its asymmetric distance table and takes the
RERANK best to be held exactly, in double precision, against the original vectors. What that may have missed is looked up: a row is no
further from its code than the length of what the code leaves over, and no row of a list is further from its centroid than the furthest, so rows and
then lists that could by these bounds still hold a nearer one are held exactly too. Answers are therefore the nearest of all rows, however the rows lie;
that decides only how many are looked at. Where most lists would be visited, all are at once.
A list is worked on in blocks of about BLOCK_ROWS, so a list that holds a third of
all rows is many tasks. A task holds one block, and queries stream past it; over
QUERY_ROWS queries are parted, and each part meets every block in its own task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import materialize

SAMPLE = 20_000
SUBSPACES = 16
CODES = 256
RERANK = 64
RECALL = 0.98
BLOCK_ROWS = 8_192
QUERY_ROWS = 200_000
QUERY_BATCH = 64
#: Allowed for single precision in bounds of distances between unit vectors and of their squares.
SLACK = 1e-5
#: Tasks of the search, where there are so many blocks.
MOST_TASKS = 10_000
MOST_LISTS = 16_384
TWO_LEVELS = 256


def _parse(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, x): the vectors that take part, as doubles, each scaled by a power of two so that squares neither overflow nor vanish; cosines stay what they are."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        n = len(ids)
        size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        ok = (size == dim) & ~ids.is_null().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(ok)
        flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component is NaN
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(flat).all(1) & (np.abs(flat).max(1, initial=0) > 0)
        rows, flat = rows[good], flat[good]
        flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(1, initial=0))[1][:, None])
        if n and len(rows):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)).cast(pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["vec_id", "x"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c to each row of x."""
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _near(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


@dataclass
class Index:
    tops: np.ndarray
    first: np.ndarray  # of each of tops, where its part of coarse starts; one more entry at the end
    coarse: np.ndarray
    books: np.ndarray  # subspace, code, dimension
    probes: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest centroid under the nearest of tops."""
        if len(self.tops) == 1:
            return _near(x, self.coarse)
        top, own = _near(x, self.tops), np.zeros(len(x), np.int64)
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            a, b = self.first[t : t + 2]
            own[rows] = a + _near(x[rows], self.coarse[a:b])
        return own

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.place(x)
        rest = (x - self.coarse[own]).reshape(len(x), len(self.books), -1)
        return own, np.stack([_near(rest[:, j], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query visits: the nearest ones, on to `least` rows together."""
        order = np.argsort((self.coarse**2).sum(1) - 2 * (q @ self.coarse.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        wanted = (np.arange(len(sizes)) < self.probes) | (before < least)
        return [row[ok] for row, ok in zip(order, wanted, strict=True)]

    def within(self, q: np.ndarray, reach: float, radius: np.ndarray) -> np.ndarray:
        """The lists that may hold a row within reach of q; radius: how far the rows of each lie from its centroid at most, -1 for none."""
        far = np.sqrt(((self.coarse - q) ** 2).sum(1))
        return np.flatnonzero((radius >= 0) & (far <= reach + radius + SLACK))


def list_count(rows: int) -> int:
    return int(min(max(1, np.sqrt(rows) / 4), MOST_LISTS))


def fit(x: np.ndarray, rows: int, subspaces: int = SUBSPACES, recall: float = RECALL, k: int = 5, seed: int = 3, two_levels: int = TWO_LEVELS) -> Index:
    """An index for `rows` vectors from a sample x of unit vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    lists = min(list_count(rows), max(1, len(x) // 16))
    tops = _kmeans(x, int(np.ceil(np.sqrt(lists))) if lists >= two_levels else 1, rng)
    if len(tops) == 1:
        coarse, first = _kmeans(x, lists, rng), np.array([0, lists])
    else:
        top = _near(x, tops)
        parts = [_kmeans(x[top == t], max(1, round(lists * (top == t).sum() / len(x))), rng) if (top == t).any() else tops[t : t + 1] for t in range(len(tops))]
        coarse, first = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    index = Index(tops, first, coarse, np.zeros((0, 0, 0)), 0)
    own = index.place(x)
    while x.shape[1] % subspaces:
        subspaces -= 1
    rest = (x - coarse[own]).reshape(len(x), subspaces, -1)
    books = np.stack([_kmeans(rest[:, j], CODES, rng) for j in range(subspaces)])
    asked = np.arange(len(x))[:: max(1, len(x) // 400)]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort((coarse**2).sum(1) - 2 * (x[asked] @ coarse.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    ranks = np.sort(np.take_along_axis(place, own[best], 1).ravel()) if best.size else np.zeros(1, int)
    return Index(tops, first, coarse, books, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1)


class _Block:
    """Rows of one list, ready to be searched."""

    def __init__(self, index: Index, rows: pa.Table):
        rows = rows.sort_by("vec_id")
        self.index, self.ids, self.x = index, rows["vec_id"].to_numpy(), _matrix(rows["x"])
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(self.ids), -1).astype(np.int64)
        codes += np.arange(codes.shape[1]) * index.books.shape[1]
        self.codes = np.ascontiguousarray(codes.T)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.centre = index.coarse[rows["list"][0].as_py()]
        self.square = (index.books**2).sum(2)
        self.unit = _unit(self.x)
        told = np.concatenate([b[c - j * index.books.shape[1]] for j, (b, c) in enumerate(zip(index.books, self.codes, strict=True))], 1)
        self.left = np.sqrt(((self.unit - self.centre - told) ** 2).sum(1))

    def search(self, asked: np.ndarray, x: np.ndarray, floors: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """nearest for each query; cosines with all rows, where one needs them, are worked out for QUERY_BATCH queries together."""
        for a in range(0, len(asked), QUERY_BATCH):
            ids, qs = asked[a : a + QUERY_BATCH], x[a : a + QUERY_BATCH]
            dots = cache(lambda qs=qs: _unit(qs) @ self.unit.T)
            for i, (qid, q, floor) in enumerate(zip(ids, qs, floors[a : a + QUERY_BATCH], strict=True)):
                yield qid, *self.nearest(qid, q, k, rerank, floor, lambda i=i, dots=dots: dots()[i])

    def nearest(self, qid: int, q: np.ndarray, k: int, rerank: int, floor: float, dots: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best rows. The `rerank` nearest by the distance table come first; then those that may by their bounds be as near as the k-th of these, and at least as near as floor."""
        books, ids = self.index.books, self.ids
        unit = _unit(q[None])[0]
        rest = (unit - self.centre).reshape(len(books), 1, -1)
        table = (self.square - 2 * (books * rest).sum(2)).ravel()
        far = table[self.codes[0]]
        for c in self.codes[1:]:
            far += table[c]
        if len(ids) > rerank + 1:
            edge = np.partition(far, rerank)[rerank]
            below, same = np.flatnonzero(far < edge), np.flatnonzero(far == edge)
            some = np.concatenate([below, same[: rerank + 1 - len(below)]])
        else:
            some = np.arange(len(ids))
        found, score = self._best(some, qid, q, k)
        if len(some) < len(ids):
            if len(found) == k:
                floor = max(floor, score[-1])
            near = far + (rest * rest).sum() - SLACK <= (_reach(floor) + self.left + SLACK) ** 2
            if 4 * np.count_nonzero(near) > len(ids):
                near &= dots() >= floor - SLACK
            near[some] = True
            found, score = self._best(np.flatnonzero(near), qid, q, k)
        return found, score

    def _best(self, some: np.ndarray, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best of some rows, held exactly."""
        some = np.sort(some[self.ids[some] != qid])
        score = (self.x[some] * q).sum(1) / (self.norms[some] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some[best]], score[best]


def _reach(score: float) -> float:
    """How far apart unit vectors of that cosine are."""
    return float(np.sqrt(max(0.0, 2 - 2 * score)))


def _answer(index: Index, k: int, rerank: int):
    """Search each block for its queries. Rows come by (list, block, part), the block's before the queries, which stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[pa.RecordBatch] = []
        block: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "part", "asks")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in pairwise(edges):
                rows = batch.slice(a, b - a)
                if key != (key := tuple(keys[:3, a])):
                    held, block = [], None
                if not keys[3, a]:
                    held.append(rows)
                    continue
                if held:
                    block, held = _Block(index, pa.Table.from_batches(held)), []
                if block is None:
                    continue
                found = list(block.search(rows.column("vec_id").to_numpy(), _matrix(rows.column("x")), rows.column("floor").to_numpy(), k, rerank))
                ids, score = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                asked = np.repeat(rows.column("vec_id").to_numpy(), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, rerank: int = RERANK, recall: float = RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of vectors (vec_id, embedding) to each of queries (vec_id, embedding).

    A row of vectors with the query's own vec_id is no candidate of it. Ties go to the
    smaller vec_id; all candidates are returned if there are fewer. Vectors that are
    null, zero, or hold null or non-finite components, those without a vec_id and those of another length
    than most take no part. Repeated rows are candidates each; of queries with one vec_id, that whose vector has the least bytes is asked. No vectors or no queries, no rows. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    length = vectors.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    if not length:
        return spark.createDataFrame([], schema)
    dim = length[0]["n"]
    parse = lambda df: df.select("vec_id", "embedding").mapInArrow(lambda b: _parse(b, dim), "vec_id long, x binary")
    clean = materialize(parse(vectors), "vectors")
    rows = clean.count()
    some = clean.select("x", "vec_id").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "x").limit(max(sample, 16 * list_count(rows))).select("x").toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    index = fit(_unit(_matrix(some["x"])), rows, recall=recall, k=k, seed=seed)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("x")))
                own, codes = shared.value.encode(unit)
                far = np.sqrt(((unit - shared.value.coarse[own]) ** 2).sum(1)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far)], names=["vec_id", "x", "list", "code", "far"])

    coded = materialize(clean.mapInArrow(encode, "vec_id long, x binary, list int, code binary, far double"), "coded")
    lists = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # MOST_LISTS rows at most
    sizes = {r["list"]: r["n"] for r in lists}
    counts, radius = np.zeros(len(index.coarse), np.int64), np.full(len(index.coarse), -1.0)
    for r in lists:
        counts[r["list"]], radius[r["list"]] = r["n"], r["far"]
    whole = 2 * index.probes > len(index.coarse)
    blocks = {a: -(-n // block_rows) for a, n in sizes.items()}
    queried = materialize(parse(queries).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    parts = -(-queried.count() // query_rows)
    if not parts:
        return spark.createDataFrame([], schema)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists that each query visits first."""
        for batch in batches:
            if batch.num_rows:
                to = [np.flatnonzero(counts)] * batch.num_rows if whole else shared.value.lists(_unit(_matrix(batch.column("x"))), counts, 16 * rerank)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array([t.tolist() for t in to], pa.list_(pa.int32())), pa.array(np.full(batch.num_rows, -2.0))], names=["vec_id", "x", "lists", "floor"])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists not visited yet that may hold a row as near as the k-th found."""
        for batch in batches:
            if batch.num_rows:
                floors = batch.column("floor").to_numpy()
                units, seen = _unit(_matrix(batch.column("x"))), batch.column("lists").to_pylist()
                to = [np.setdiff1d(shared.value.within(u, _reach(f), radius), s) for u, f, s in zip(units, floors, seen, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array([t.tolist() for t in to], pa.list_(pa.int32())), pa.array(floors)], names=["vec_id", "x", "lists", "floor"])

    visits = "vec_id long, x binary, lists array<int>, floor double"
    count = F.create_map(*[F.lit(int(v)) for pair in sorted(blocks.items()) for v in pair])
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(count, F.col("list"))).cast("int")
    key = ["list", "block", "part"]
    there = coded.select("vec_id", "x", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("asks"), "code", F.lit(None).cast("double").alias("floor"))
    tasks = min(MOST_TASKS, sum(blocks.values()) * parts)

    def search(asking: DataFrame) -> DataFrame:
        asked = asking.select("vec_id", "x", F.explode("lists").alias("list"), "floor").where(F.element_at(count, F.col("list")).isNotNull())
        asked = asked.select("vec_id", "x", "list", F.explode(F.sequence(F.lit(0), F.element_at(count, F.col("list")) - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("asks"), F.lit(None).cast("binary").alias("code"), "floor")
        both = there.unionByName(asked).repartition(tasks, *key).sortWithinPartitions(*key, "asks")
        return both.mapInArrow(_answer(index, k, rerank), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = queried.mapInArrow(visit, visits)
    if whole:
        return best(search(asking))
    asking = materialize(asking, "visits")
    first = materialize(best(search(asking)), "found")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    more = asking.join(floors, "vec_id", "left").select("vec_id", "x", "lists", F.coalesce("kth", "floor").alias("floor"))
    more = materialize(more.mapInArrow(beyond, visits).where(F.size("lists") > 0), "visits")
    if more.isEmpty():
        return first
    return best(first.select("query_id", "vec_id", "score").unionByName(search(more)))
