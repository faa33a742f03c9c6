"""Rules that compose a relation with pairs, (path x y) (edge y z) to (path x z), run to their end in one step.

The new rows are dealt by x, which such a rule passes on, and each task follows the pairs
from its own x as far as they lead: no round of its own for each length of path, and no shuffle
of what is found. The pairs are sent to every task; more than MOST_PAIRS are left to the general loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import syntax as S
from quern.catalog import Catalog
from quern.plans.query import Query
from quern.storage import BROADCAST_ROWS

#: Pairs of a step that are sent to all tasks, at 8 bytes each and 8 for each node.
MOST_PAIRS = 10_000_000
#: A task follows as many starts together as have so many (start, node), a byte each, but not more than MOST_STARTS.
CELLS, MOST_STARTS = 128 << 20, 1_024
#: Pairs followed and rows given at once.
SLICE = 1 << 20
MOST_TASKS = 2_000

#: What a row given to a task is: there and followed to the end before; there; derived.
DONE, THERE, DERIVED = 0, 1, 2


@dataclass(frozen=True)
class Closure:
    """path composed with step on its right, or, flipped, on its left."""

    path: str
    step: str
    flip: bool


def closure_of(head: tuple[S.Action, ...], query: Query, catalog: Catalog) -> Closure | None:
    """What the rule composes, if it is of that form over pairs of integers."""
    if len(head) != 1 or not isinstance(head[0], S.Get) or len(query.atoms) != 2 or query.computed:
        return None
    to = head[0]
    pairs = [catalog.function(n) for n in (to.name, *(a.name for a in query.atoms))]
    if any(f.output != S.UNIT or f.inputs != (S.INT, S.INT) for f in pairs) or not all(isinstance(e, S.Var) for e in to.args):
        return None
    ends = tuple(query.names[e.name] for e in to.args)
    for a, b in (query.atoms, query.atoms[::-1]):
        x, y, z = *a.args, b.args[1]
        if b.args[0] == y and ends == (x, z) and len({x, y, z}) == 3 and not {x, y, z} & query.constants.keys():
            if a.name == to.name:
                return Closure(to.name, b.name, False)
            if b.name == to.name:
                return Closure(to.name, a.name, True)
    return None


@dataclass
class Pairs:
    """Pairs (a, b) by a: those of nodes[i] lead to nodes[to[first[i] : first[i + 1]]]."""

    nodes: np.ndarray
    first: np.ndarray
    to: np.ndarray
    several: np.ndarray  # whether more than one pair leads to a node

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Pairs:
        nodes = np.unique(np.concatenate([a, b]))
        a, b = (np.searchsorted(nodes, c).astype(np.int32) for c in (a, b))
        order = np.argsort(a, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(nodes)))])
        return cls(nodes, first, b[order], np.bincount(b, minlength=len(nodes)) > 1)

    def follow(self, start: np.ndarray, y: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, y) that are derived from the rows given and not there: start in 0, 1, ..., y any value, each once."""
        n = len(self.nodes)
        at = np.searchsorted(self.nodes, y)
        known = self.nodes[np.minimum(at, n - 1)] == y
        cell, kind = (start.astype(np.int64) * n + at)[known], kind[known]
        seen = np.zeros((int(start.max()) + 1) * n, bool)
        seen[cell[kind == DONE]] = True
        there, derived = (np.unique(cell[kind == k]) for k in (THERE, DERIVED))
        there = there[~seen[there]]
        seen[there] = True
        derived = derived[~seen[derived]]
        seen[derived] = True
        found, held, todo = [derived], len(derived), [there, derived]
        while todo:
            cell = todo.pop()
            if len(cell) > SLICE:
                todo.append(cell[SLICE:])
                cell = cell[:SLICE]
            y = cell % n
            least = self.first[y]
            many = self.first[y + 1] - least
            ends = np.cumsum(many)
            if not len(ends) or not ends[-1]:
                continue
            if ends[-1] > 4 * SLICE and len(cell) > 1:
                todo += [cell[len(cell) // 2 :], cell[: len(cell) // 2]]
                continue
            z = self.to[np.repeat(least - ends + many, many) + np.arange(ends[-1])]
            cell = np.repeat(cell - y, many) + z
            fresh = ~seen[cell]
            cell = cell[fresh]
            if not len(cell):
                continue
            if self.several[z[fresh]].any():
                cell = np.unique(cell)
            seen[cell] = True
            todo.append(cell)
            found.append(cell)
            held += len(cell)
            if held >= SLICE:
                yield from self._told(found)
                found, held = [], 0
        yield from self._told(found)

    def _told(self, found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(cell):
            # by start, which files then hold in few bytes
            cell.sort()
            yield cell // len(self.nodes), self.nodes[cell % len(self.nodes)]


def compose(seeds: DataFrame, n: int, done: DataFrame | None, step: DataFrame) -> DataFrame:
    """(c0, c1) derived by composing rows with the pairs of step, again and again.

    seeds: (c0, c1, kind), n stored rows, THERE or DERIVED. done: (c0, c1), the rows that are
    there beside; what they give by step is there or among the seeds. Neither comes out again, nor any row twice.
    """
    spark = step.sparkSession
    table = step.toArrow()
    shared = spark.sparkContext.broadcast(Pairs.of(table.column(0).to_numpy(), table.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        most = max(1, min(MOST_STARTS, CELLS // len(pairs.nodes)))
        held: list[pa.RecordBatch] = []
        starts, last = 0, None

        def give() -> Iterator[pa.RecordBatch]:
            x, y, kind = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            own, start = np.unique(x, return_inverse=True)
            for s, z in pairs.follow(start, y, kind):
                for a in range(0, len(s), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(own[s[a : a + SLICE]]), pa.array(z[a : a + SLICE])], names=["c0", "c1"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).to_numpy()
            news = np.concatenate([[x[0] != last], x[1:] != x[:-1]]) if last is not None else np.concatenate([[True], x[1:] != x[:-1]])
            number, last, a = starts + np.cumsum(news), x[-1], 0  # of each row's start, from 1
            while number[-1] > most:
                b = int(np.searchsorted(number, most, "right"))
                held.append(batch.slice(a, b - a))
                yield from give()
                held, number, a = [], number - most, b
            held.append(batch.slice(a))
            starts = int(number[-1])
        if held:
            yield from give()

    rows = seeds.select("c0", "c1", "kind")
    if done is not None:
        starts = seeds.select("c0").distinct()
        rows = rows.unionByName(done.join(F.broadcast(starts) if n <= BROADCAST_ROWS else starts, "c0", "left_semi").select("c0", "c1", F.lit(DONE).alias("kind")))
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism if n > SLICE >> 6 else 1, n // 256))
    return rows.repartition(tasks, "c0").sortWithinPartitions("c0").mapInArrow(run, "c0 long, c1 long")
