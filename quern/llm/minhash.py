"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each whole text gets its shingle set's size, a 128-bit cryptographic digest of the
   set and a signature of COORDINATES coordinates. Sets with one digest become one node,
   so copies cost nothing below: among 10^11 sets a false match has a chance of 10^-17.
2. Nodes are posted under each (coordinate, value). Values that one node alone has
   are dropped; the rest are ordered from rare to frequent. Two nodes that agree in
   MATCHES coordinates at least must meet under one of the first
   COORDINATES - MATCHES + 1 of each, so only that prefix is posted again.
3. Within a posting list, collisions are counted against nodes not yet reached,
   skipping the rest: what comes out is a forest, not all pairs. A list of over
   LIST_NODES nodes is joined into one candidate group without counting, which is
   a superset of what counting would keep: the one place where collisions aren't counted.
   A value that very many nodes have is dealt to several tasks by node.
4. Candidate groups are resolved on the full sets. A group of up to TASK_SHINGLES
   is searched in one task. A larger one is first held against its most central node;
   only nodes that this leaves over are then held, block by block, against all blocks.
   Sets are compared by both 64-bit lanes of their shingles' hashes, see shingles.
5. Confirmed links give connected components.

At a similarity of 0.85, 64 coordinates agree in 54.4 on average with a standard
deviation of 2.9; 36 lies more than six deviations below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import forget, groups, keyed, materialize, pieces, small, text_buffer
from quern.llm.shingles import Lanes, fingerprint, multipliers, shingle_sets, signatures
from quern.operators.components import distributed_roots
from quern.storage import BROADCAST_ROWS, Workspace

COORDINATES = 64
MATCHES = 36
LIST_NODES = 4096
TASK_SHINGLES = 2_000_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node on a link of links (a, b); component is the smallest node that links reach."""
    with Workspace(links.sparkSession) as space:
        found = distributed_roots(links, space)
        return materialize(found.select(F.col("id").alias("node"), F.col("root").alias("component")).union(found.select("root", "root").distinct()), "components")


def _sign(coordinates: int, seed: int, keep: list[str]):
    odd = multipliers(coordinates, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            sets = shingle_sets(*text_buffer(part.column("text")))
            n = pa.array([len(s[0]) for s in sets], pa.int64())
            prints = pa.array([fingerprint(s) if len(s[0]) else None for s in sets], pa.binary())
            sig = signatures([s[0] for s in sets], odd)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), n, prints, lists], names=[*keep, "n_shingles", "print", "sig"])

    return run


def sign(docs: DataFrame, key: str, coordinates: int = COORDINATES, seed: int = 1) -> DataFrame:
    """(doc_id, key, n_shingles, print, sig) of each row of docs (doc_id, text, key). Texts that are null or without words have n_shingles 0 and print null."""
    docs = docs.select(F.col("doc_id").cast("long"), key, "text")
    return docs.mapInArrow(_sign(coordinates, seed, ["doc_id", key]), f"doc_id long, `{key}` {docs.schema[key].dataType.simpleString()}, n_shingles long, print binary, sig array<int>")


def _forest(sigs: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Links that span what agreement in `matches` coordinates connects: a search from each row through rows not yet reached."""
    out, left = [], np.arange(len(sigs))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = (sigs[left] == sigs[x]).sum(1) >= matches
            if hit.any():
                found = left[hit]
                out += [(x, y) for y in found]
                front += list(found)
                left = left[~hit]
    return out


def _collide(coordinates: int, matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            table = table.combine_chunks()
            keys, nodes = table["key"].to_numpy(), table["node"].to_numpy()
            sigs = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.concatenate([first, [len(keys)]]))
            two = first[size == 2]
            two = two[(sigs[two] == sigs[two + 1]).sum(1) >= matches]
            links = [np.stack([nodes[two], nodes[two + 1]], 1)]
            for a, n in zip(first[size > 2], size[size > 2], strict=True):
                if found := _forest(sigs[a : a + n], matches):
                    links.append(nodes[a + np.array(found)])
            pairs = np.unique(np.sort(np.concatenate(links), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def candidates(nodes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, list_nodes: int = LIST_NODES) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, sig), a stored table: links (a, b) spanning the candidate groups; and (node, weight), how common a node's values are."""
    postings = nodes.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.expr("shiftleft(cast(k as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("key"))
    with Workspace(nodes.sparkSession) as space:
        counts, facts = space.measured(postings.groupBy("key").count().where("count > 1"), "counts", hot=F.col("count") > list_nodes)
        own = materialize(_own(postings, counts, facts["hot"], list_nodes, matches - 1), "prefix")
    lists = own.select("node", F.explode("own").alias("x")).select("node", "x.key", "x.count")
    long = lists.where(F.col("count") > list_nodes)
    hubs = materialize(long.groupBy("key").agg(F.min("node").alias("a")), "hubs")
    joined = long.join(small(hubs), "key").select("a", F.col("node").alias("b")).where("a <> b")
    short = nodes.join(small(own.select("node")), "node").join(own.select("node", "own"), "node").select("node", "sig", F.explode("own").alias("x")).where(F.col("x.count") <= list_nodes).select("x.key", "node", "sig")
    counted = short.repartition("key").sortWithinPartitions("key").mapInArrow(_collide(coordinates, matches), "a long, b long")
    return counted.unionByName(joined), own.select("node", "weight")


def _own(postings: DataFrame, counts: DataFrame, hot: int, list_nodes: int, spare: int) -> DataFrame:
    """(node, weight, own) of nodes that have over `spare` values in common with others: own lists these values but the `spare` most frequent.

    A value of over list_nodes nodes, of which there are few, is dealt to as many tasks as it has list_nodes.
    """
    salts = F.ceil(F.col("count") / list_nodes).cast("int")
    if hot:
        split = small(counts.where(F.col("count") > list_nodes).select("key", salts.alias("salts")))
        postings = postings.join(split, "key", "left").select("node", "key", F.coalesce(F.pmod(F.hash("node"), F.col("salts")), F.lit(0)).alias("salt"))
        counts = counts.select("key", "count", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        found = postings.join(counts, ["key", "salt"])
    else:
        found = postings.join(counts, "key")
    own = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("own")).where(F.size("own") > spare)
    return own.select("node", F.expr("aggregate(own, 0L, (s, x) -> s + x.count)").alias("weight"), F.expr(f"slice(own, 1, size(own) - {spare})").alias("own"))


def _linked(x: Lanes, y: Lanes, percent: int) -> bool:
    """Whether two sets are linked; an exact count on both lanes."""
    if (x[0][1:] == x[0][:-1]).any():
        common = len(set(zip(*map(np.ndarray.tolist, x), strict=True)) & set(zip(*map(np.ndarray.tolist, y), strict=True)))
    else:
        at = np.searchsorted(x[0], y[0])
        at[at == len(x[0])] = 0
        common = int(((x[0][at] == y[0]) & (x[1][at] == y[1])).sum())
    return 100 * common >= percent * (len(x[0]) + len(y[0]) - common)


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for pairs of two lanes, equal ones for equal pairs, and how many there are."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if (same & (b[order][1:] != b[order][:-1])).any():
        order = np.lexsort((b, a))
        same = a[order][1:] == a[order][:-1]
    same &= b[order][1:] == b[order][:-1]
    number = np.empty(len(a), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(~same)])
    return number, int(number[order[-1]]) + 1


def _search(sets: list[Lanes], queries: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the sets in which a query takes part; sets of another size than a query's can't be linked with it and are passed over."""
    inverse, values = _numbered(*(np.concatenate(lane) for lane in zip(*sets, strict=True)))
    sizes = np.array([len(s[0]) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    local = [inverse[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(values, bool)
    out: list[tuple[int, int]] = []
    left = np.argsort(sizes, kind="stable")
    reached = np.zeros(len(sets), bool)
    for q in np.argsort(-sizes, kind="stable"):
        if reached[q]:
            continue
        reached[q] = True
        front = [q]
        while front:
            x = front.pop()
            left = left[~reached[left]]
            lo = np.searchsorted(sizes[left], -(-percent * sizes[x] // 100))
            hi = np.searchsorted(sizes[left], 100 * sizes[x] // percent, side="right")
            some = left[lo:hi]
            if not queries[x]:
                some = some[queries[some]]
            if not len(some):
                continue
            mark[local[x]] = True
            n = sizes[some]
            common = np.add.reduceat(mark[np.concatenate([local[y] for y in some])], np.cumsum(n) - n, dtype=np.int64)
            mark[local[x]] = False
            found = some[100 * common >= percent * (sizes[x] + n - common)]
            out += [(x, y) for y in found]
            reached[found] = True
            front += list(found)
    return out


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text by the two lanes of its shingles' hashes."""
    for part in pieces(batches):
        sets = shingle_sets(*text_buffer(part.column("text")))
        ends = pa.array(np.cumsum([0, *(len(s[0]) for s in sets)]).astype(np.int32))
        lanes = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s[i] for s in sets]).view(np.int64))) for i in (0, 1)]
        i = part.schema.get_field_index("text")
        yield part.set_column(i, "shingles", lanes[0]).append_column("second", lanes[1])


def _links(pairs: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _lists(table: pa.Table, *columns: str) -> list[Lanes]:
    out = []
    for column in columns:
        col = table[column].combine_chunks()
        flat, offs = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
        out.append([flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)])
    return list(zip(*out, strict=True))


def _resolve(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            table = table.combine_chunks()
            keys, nodes = table["task"].to_numpy(zero_copy_only=False), table["node"].to_numpy()
            query, sets = table["query"].to_numpy(zero_copy_only=False), _lists(table, "shingles", "second")
            first = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys)]
            pairs = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                if found := _search(sets[a:b], query[a:b], percent):
                    pairs.append(nodes[a + np.array(found)])
            yield _links(pairs)

    return run


def _hold(percent: int):
    """Hold each row's set against its group's central set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ok = [_linked(c, s, percent) for s, c in zip(_lists(table, "shingles", "second"), _lists(table, "central", "central2"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), pa.array(ok)], names=["node", "hub", "ok"])

    return run


def confirmed(members: DataFrame, percent: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Links (a, b) that span the components of members (node, component, weight, n_shingles, shingles, second), a stored table, on full sets."""
    size = members.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.max_by("node", F.struct("weight", F.col("node"))).alias("hub"))
    size = materialize(size, "groups")
    ready = members.join(size.where(F.col("total") <= task_shingles).select("component"), "component")
    tasks = ready.select(F.col("component").alias("task"), "node", F.lit(True).alias("query"), "shingles", "second")
    links = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_resolve(percent), "a long, b long")

    large = size.where(F.col("total") > task_shingles)
    if large.isEmpty():
        return links
    large = large.withColumn("n", F.ceil(F.col("total") * 2 / task_shingles).cast("int"))
    many = members.join(large, "component")
    hubs = many.where("node = hub").select("component", F.col("shingles").alias("central"), F.col("second").alias("central2"))
    held = materialize(many.where("node <> hub").join(small(materialize(hubs, "central"), weight=F.size("central")), "component").select("node", "hub", "shingles", "second", "central", "central2").mapInArrow(_hold(percent), "node long, hub long, ok boolean"), "held")
    rest = many.join(held.where("not ok").select("node"), "node").withColumn("own", F.pmod(F.hash("node"), F.col("n")))
    every = many.withColumn("own", F.pmod(F.hash("node"), F.col("n")))
    pair = lambda q, y: F.xxhash64("component", q, y)
    asked = rest.select("node", "component", "own", "shingles", "second", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).select(pair("own", "at").alias("task"), "node", F.lit(True).alias("query"), "shingles", "second")
    there = rest.select("component", "own", "n").distinct().select("component", F.col("own").alias("at"))
    found = every.join(there, "component").select(pair("at", "own").alias("task"), "node", F.lit(False).alias("query"), "shingles", "second")
    blocks = asked.unionByName(found).repartition("task").sortWithinPartitions("task").mapInArrow(_resolve(percent), "a long, b long")
    return links.unionByName(blocks).unionByName(held.where("ok").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def near_duplicates(
    docs: DataFrame, percent: int = 85, coordinates: int = COORDINATES, matches: int = MATCHES, list_nodes: int = LIST_NODES, task_shingles: int = TASK_SHINGLES, seed: int = 1, key: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, chosen[, key]) for each row of docs (doc_id, text); other columns of docs are not looked at.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle
    sets; component_id is the smallest doc_id that links reach, kept says that it is
    the document's own. Texts that are null, empty or without words have n_shingles 0
    and are linked with nothing. Long texts count whole. Repeated rows have equal
    sets and are linked; rows with the same doc_id are all kept if it is the smallest.
    A row without a doc_id is linked like any other; component_id is null if no row of its
    component has one, and kept is chosen there. chosen holds for exactly one row of each component and
    for each row linked with nothing: of the least doc_id, those without one last, then by key.
    key names a column that tells rows apart; without it, one is made. No rows, no rows.
    """
    given = key is not None
    if not given:
        docs, key = keyed(docs)
    signed = materialize(sign(docs, key, coordinates, seed), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col(key).alias("key"))
    known = signed.where("print is not null").select("*", F.monotonically_increasing_id().alias("number"))
    nodes = known.groupBy("print").agg(F.min("number").alias("node"), F.min(first).alias("first"), F.max("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    nodes = materialize(nodes, "nodes")
    links, weights = candidates(nodes, coordinates, matches, list_nodes)
    links = materialize(links, "candidates")
    grouped = connected_components(links)
    near = materialize(grouped.join(weights, "node").join(nodes.select("node", F.col("first.key").alias(key), "n_shingles"), "node"), "near")
    texts = docs.select(key, "text").join(small(near, BROADCAST_ROWS // 4), key)
    members = texts.select("node", "component", "weight", "n_shingles", "text").mapInArrow(_with_sets, "node long, component long, weight long, n_shingles long, shingles array<long>, second array<long>")
    members = materialize(members, "members")
    sure = materialize(confirmed(members, percent, task_shingles), "confirmed")
    linked = connected_components(sure)
    group = nodes.select("node", "first").join(linked, "node")
    least = materialize(group.groupBy("component").agg(F.min("first").alias("least")), "least")
    group = group.join(small(least, BROADCAST_ROWS // 4), "component").select("node", "least")
    of_set = nodes.select("node", "print", "first").join(group, "node", "left").select("print", F.coalesce("least", "first").alias("least"))
    of_set = materialize(of_set, "sets")
    forget(links, grouped, near, members, sure, linked, least)
    found = signed.select("doc_id", key, "n_shingles", "print").join(small(of_set, BROADCAST_ROWS // 4), "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    chosen = F.col("print").isNull() | (F.col(key) == F.col("least.key"))
    kept = F.coalesce(component == F.col("doc_id"), chosen)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen"), *([key] if given else []))
