"""A function's table: rows (c0, c1, ..., out, _e), unique in its inputs, kept as parts of known epochs.

Parts are only ever added. _e is the epoch in which a row's present version was
written, so ranges of epochs are mostly whole parts and need no filter. A row whose
output or ids change is written anew in a later part, and its inputs are noted as dead
for the parts so far: reading leaves them out there. Parts of like size are written
together now and then, so a row is rewritten about as often as the table has doubled.

What a table holds already is looked up from the side of the new rows: up to
BROADCAST_ROWS of them are sent to where the table lies, which is read but not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import spark_type
from quern.errors import ProgramError
from quern.functions.merges import Merge, fold_column
from quern.operators.components import BROADCAST_ROWS
from quern.storage import LOCAL_ROWS, Workspace
from quern.syntax import BASE_TYPES, Function

#: Parts beyond which some of the older ones are written together.
MOST_PARTS = 6
#: A table of up to so many rows is joined as it is.
FEW_ROWS = 200_000


@dataclass(frozen=True)
class Part:
    rows: DataFrame
    first: int  # epochs
    last: int
    count: int
    number: int
    local: pa.Table | None = None  # the rows, if the driver has them


@dataclass(frozen=True)
class Dead:
    """Inputs whose rows in the parts numbered since to upto count no more; fresh of them were written in this epoch."""

    keys: DataFrame
    count: int
    fresh: int
    epoch: int
    since: int
    upto: int
    local: pa.Table | None = None

    def covers(self, p: Part) -> bool:
        return self.since <= p.number <= self.upto


@dataclass(frozen=True)
class Change:
    """What an upsert did: rows written, and links (a, b) between outputs that must be one."""

    rows: int
    links: DataFrame | None = None


class FunctionTable:
    def __init__(self, f: Function, merge: Merge, space: Workspace):
        self.f, self.merge, self.space = f, merge, space
        self.keys = [f"c{i}" for i in range(len(f.inputs))]
        self.kinds = [*f.inputs, f.output]
        fields = [T.StructField(c, spark_type(k)) for c, k in zip([*self.keys, "out"], self.kinds, strict=True)]
        self.schema = T.StructType([*fields, T.StructField("_e", T.LongType())])
        types = {"boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary()}
        self._arrow = pa.schema([(f.name, types.get(f.dataType.simpleString(), pa.string())) for f in self.schema])
        self.parts: list[Part] = []
        self.dead: list[Dead] = []
        self.live = 0
        self._number = 0

    @property
    def state(self) -> tuple:
        """What a failed step puts back."""
        return list(self.parts), list(self.dead), self.live

    @state.setter
    def state(self, kept: tuple) -> None:
        self.parts, self.dead, self.live = kept

    # reading

    def _rows_of(self, parts: list[tuple[Part, DataFrame]]) -> DataFrame:
        """The living rows among those of parts."""
        if not parts:
            return self.space.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        by: dict[tuple[int, ...], list[DataFrame]] = {}
        for p, df in parts:
            by.setdefault(tuple(i for i, d in enumerate(self.dead) if d.covers(p)), []).append(df)
        out = []
        for at, frames in by.items():
            df = reduce(DataFrame.unionByName, frames)
            if at:
                gone = reduce(DataFrame.unionByName, (self.dead[i].keys for i in at))
                if sum(self.dead[i].count for i in at) <= BROADCAST_ROWS:
                    gone = F.broadcast(gone)
                df = df.join(gone, self.keys, "left_anti") if self.keys else df.where("false")
            out.append(df)
        return reduce(DataFrame.unionByName, out)

    def count(self, lo: int = 0, hi: int | None = None) -> int:
        """Rows of epochs lo to hi - 1: exact for all rows and for the last epoch, else an upper bound."""
        if not lo and hi is None:
            return self.live
        n = sum(p.count for p in self.parts if p.last >= lo and (hi is None or p.first < hi))
        return n - sum(d.fresh for d in self.dead if d.epoch >= lo and (hi is None or d.epoch < hi))

    def rows(self, lo: int = 0, hi: int | None = None) -> DataFrame:
        """The live rows of epochs lo to hi - 1."""
        out = []
        for p in self.parts:
            if p.last < lo or (hi is not None and p.first >= hi):
                continue
            df = p.rows
            if p.first < lo:
                df = df.where(F.col("_e") >= lo)
            if hi is not None and p.last >= hi:
                df = df.where(F.col("_e") < hi)
            out.append((p, df))
        return self._rows_of(out)

    # writing

    def _append(self, rows: DataFrame, n: int, epoch: int, local: pa.Table | None = None) -> int:
        """Add a part of n stored rows (c0.., out), which the driver may have as well."""
        if n:
            self._number += 1
            if local is None and n <= LOCAL_ROWS:
                local = rows.select(*self.keys, "out").toArrow()
                rows = self.space.spark.createDataFrame(local, T.StructType(self.schema.fields[:-1]))
            if local is not None:
                local = local.select([*self.keys, "out"]).append_column("_e", pa.array([epoch] * n, pa.int64())).cast(self._arrow)
            stamped = rows.select(*self.keys, "out", F.lit(epoch).cast("long").alias("_e"))
            self.parts.append(Part(stamped, epoch, epoch, n, self._number, local))
            self.live += n
            self._compact(epoch)
        return n

    def _kill(self, keys: DataFrame, n: int, fresh: int, epoch: int, since: int = 0, local: pa.Table | None = None) -> None:
        """Take the rows with these stored keys, n in number, out of the parts so far."""
        if n:
            self.dead.append(Dead(keys.select(*self.keys), n, fresh, epoch, since, self._number, None if local is None else local.select(self.keys).cast(pa.schema([self._arrow.field(c) for c in self.keys]))))
            self.live -= n

    def _compact(self, epoch: int) -> None:
        """Write older parts together: the last ones of like size, or all if many of their rows are dead."""
        old = [p for p in self.parts if p.last < epoch]
        dead = sum(d.count for d in self.dead)
        local = all(x.local is not None for x in (*old, *self.dead)) and sum(p.count for p in old) <= LOCAL_ROWS
        if local and len(old) + len(self.dead) > 1:
            return self._merge(old, self._merged_locally(old) if old else None)
        if len(old) < MOST_PARTS and len(self.dead) < MOST_PARTS and dead <= max(self.live, FEW_ROWS) or not old:
            return
        if len(self.dead) >= MOST_PARTS or dead > self.live:
            some = old
        else:
            at, total = len(old) - 1, old[-1].count
            while at and (old[at - 1].count <= 2 * total or at == len(old) - 1):
                at -= 1
                total += old[at].count
            some = old[at:]
        self._merge(some)

    def _merged_locally(self, some: list[Part]) -> pa.Table:
        """The living rows of parts that the driver has."""
        out = []
        for p in some:
            rows = p.local
            for d in self.dead:
                if d.covers(p):
                    rows = rows.join(d.local, self.keys, join_type="left anti") if self.keys else rows.slice(0, 0)
            out.append(rows.select(self.schema.names))
        return pa.concat_tables(out)

    def _merge(self, some: list[Part], local: pa.Table | None = None) -> None:
        """Make one part of some."""
        if not some:
            return
        if local is not None:
            whole, n = self.space.spark.createDataFrame(local, self.schema), local.num_rows
        else:
            rows, total = self._rows_of([(p, p.rows) for p in some]), sum(p.count for p in some)
            if total <= FEW_ROWS:
                rows = rows.coalesce(max(1, min(self.space.spark.sparkContext.defaultParallelism, total // 10_000 + 1)))
            whole, facts = self.space.measured(rows, "whole")
            n = facts["n"]
        numbers = {p.number for p in some}
        merged = Part(whole, min(p.first for p in some), max(p.last for p in some), n, max(numbers), local)
        left = [p for p in self.parts if p.number not in numbers]
        self.parts = sorted([*left, *([merged] if n else [])], key=lambda p: p.number)
        self.dead = [replace(d, fresh=0 if merged.last >= d.epoch else d.fresh) for d in self.dead if any(d.covers(p) for p in left)]

    def _lookup(self, delta: DataFrame, few: bool) -> DataFrame:
        """delta, distinct in its keys, with _old and _was, output and epoch of the row that is there, or null."""
        now = self.rows().select(*self.keys, F.col("out").alias("_old"), F.col("_e").alias("_was"))
        if not self.live:
            return delta.withColumns({"_old": F.lit(None).cast(self.schema["out"].dataType), "_was": F.lit(None).cast("long")})
        if not self.keys:
            return delta.join(now, F.lit(True), "left")
        if self.live > FEW_ROWS:
            delta, facts = self.space.measured(delta, "delta", few)
            if facts["n"] <= BROADCAST_ROWS:
                now = now.join(F.broadcast(delta.select(*self.keys)), self.keys, "left_semi")
        return delta.join(now, self.keys, "left")

    def upsert(self, new: DataFrame, epoch: int, few: bool = False) -> Change:
        """Add contributions (c0.., out[, ord]), a bag; ord is their order of arrival where the merge depends on it. few: not many are expected."""
        kind = self.merge.kind
        old = F.col("_old")
        if kind == "relation":
            found = self._lookup(new.select(*self.keys, "out").distinct(), few).where(old.isNull()).select(*self.keys, "out")
            saved, facts = self.space.measured(found, self._name, few)
            return Change(self._append(saved, facts["n"], epoch, facts["table"]))
        if kind == "union":
            return self._upsert_union(new, epoch, few)
        summed = self._lookup(self._summed(new), few)
        if kind == "same":
            bad = F.coalesce((F.col("_lo") != F.col("_hi")) | (old != F.col("_lo")), F.lit(False))
            found = summed.select(*self.keys, F.col("_lo").alias("out"), "_hi", "_old", bad.alias("_bad"))
            found, facts = self.space.measured(found.where(old.isNull() | F.col("_bad")), self._name, few, bad=F.col("_bad"))
            if facts["bad"]:
                r = found.where("_bad").orderBy(*self.keys, "out").first()
                a, b = (r["_old"], r["out"]) if r["_old"] is not None and r["_old"] != r["out"] else (r["out"] if r["_old"] is None else r["_old"], r["_hi"])
                raise ProgramError(f"{a} != {b} in {self.f.name}")
            return Change(self._append(found, facts["n"], epoch, facts["table"]))
        found = summed.select(*self.keys, self._merged(old).alias("out"), "_old", "_was").where(old.isNull() | (F.col("out") != old))
        found, facts = self.space.measured(found, self._name, few, replaced=old.isNotNull(), fresh=F.col("_was") == epoch)
        local = facts["table"]
        self._kill(found.where(old.isNotNull()), facts["replaced"], facts["fresh"], epoch, local=None if local is None else local.filter(pc.is_valid(local["_old"])))
        return Change(self._append(found, facts["n"], epoch, local))

    def add(self, new: DataFrame, epoch: int) -> int:
        """Append distinct rows (c0..) of a relation that are not there; how many they are."""
        saved, facts = self.space.measured(new.select(*self.keys, F.lit(True).alias("out")), self._name)
        return self._append(saved, facts["n"], epoch)

    @property
    def _name(self) -> str:
        return self.f.name if self.f.name.isalnum() else "rows"

    def _summed(self, new: DataFrame) -> DataFrame:
        """Contributions by key, pre-aggregated as far as the merge allows."""
        kind, out = self.merge.kind, F.col("out")
        by = new.groupBy(*self.keys)
        if kind == "same":
            return by.agg(F.min(out).alias("_lo"), F.max(out).alias("_hi"))
        if kind == "min":
            return by.agg(F.min(out).alias("_v"))
        if kind == "sum":
            return by.agg(F.sum(out).alias("_v"))
        if kind == "product":
            # equal factors are counted first: 63 distinct ones over 1 already overflow
            counted = new.groupBy(*self.keys, "out").count()
            power = "aggregate(if(_x in (0, 1), array(_x), if(_x = -1, array(if(_n % 2 = 1, -1L, 1L)), array_repeat(_x, cast(least(_n, 64) as int)))), 1L, (a, x) -> a * x)"
            factors = counted.withColumns({"_x": F.col("out"), "_n": F.col("count")}).withColumn("_p", F.expr(power))
            return factors.groupBy(*self.keys).agg(F.expr("aggregate(array_sort(collect_list(_p)), 1L, (a, x) -> a * x)").alias("_v"))
        if kind == "first":
            return by.agg(F.min_by(out, F.col("ord")).alias("_v"))
        if kind == "last":
            return by.agg(F.max_by(out, F.col("ord")).alias("_v"))
        return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "out"))), lambda x: x["out"]).alias("_vs"))

    def _merged(self, old: Column) -> Column:
        """The new output from _old, which may be null, and what _summed made."""
        kind, v = self.merge.kind, F.col("_v")
        if kind == "fold":
            e = self.merge.expr
            vs = F.col("_vs")
            first = F.coalesce(old, F.element_at(vs, 1))
            rest = F.when(old.isNull(), F.slice(vs, 2, F.size(vs))).otherwise(vs)
            return F.aggregate(rest, first, lambda a, x: fold_column(e, a, x))
        both = {"min": F.least(old, v), "sum": old + v, "product": old * v, "first": old, "last": v}[kind]
        return F.when(old.isNull(), v).otherwise(both)

    def _upsert_union(self, new: DataFrame, epoch: int, few: bool) -> Change:
        """Outputs that meet are linked; the row there, or else the least output, stays."""
        new = new.select(*self.keys, "out")
        met = self._lookup(new.groupBy(*self.keys).agg(F.min("out").alias("_lo"), F.max("out").alias("_hi")), few)
        met = met.select(*self.keys, F.coalesce("_old", "_lo").alias("out"), "_lo", "_hi", F.col("_old").isNull().alias("_fresh"))
        met, facts = self.space.measured(met, self._name, few, fresh=F.col("_fresh"), moved=F.col("_lo") != F.col("out"), several=F.col("_lo") != F.col("_hi"))
        links = []
        if facts["moved"]:
            links.append(met.where("_lo <> out").select(F.col("out").alias("a"), F.col("_lo").alias("b")))
        if facts["several"]:
            # keys with more than one new output: few, so their rows meet them where they are
            several = met.where("_lo <> _hi").select(*self.keys, F.col("out").alias("_root"))
            several = F.broadcast(several) if facts["several"] <= BROADCAST_ROWS else several
            pairs = new.join(several, self.keys) if self.keys else new.join(several, F.lit(True))
            links.append(pairs.where("out <> _root").select(F.col("_root").alias("a"), F.col("out").alias("b")))
        n = self._append(met.where("_fresh"), facts["fresh"], epoch, None if facts["table"] is None else facts["table"].filter(facts["table"]["_fresh"]))
        return Change(n, reduce(DataFrame.unionByName, links) if links else None)

    def rename(self, dirty: DataFrame, sort: str, epoch: int, fresh_only: bool, few: bool = False) -> DataFrame | None:
        """Replace ids of a sort by their roots (dirty: id, root). The rows touched leave the table and are returned as contributions, or, if only outputs change, are put back with their new ones.

        fresh_only: no id of before this epoch changes, so older parts needn't be looked at.
        """
        columns = [c for c, k in zip([*self.keys, "out"], self.kinds, strict=True) if k == sort]
        some = [p for p in self.parts if not fresh_only or p.last >= epoch]
        if not columns or sort in BASE_TYPES or not some:
            return None
        df = self._rows_of([(p, p.rows) for p in some])
        for c in columns:
            df = df.join(dirty.select(F.col("id").alias(f"_i_{c}"), F.col("root").alias(f"_r_{c}")), F.col(c) == F.col(f"_i_{c}"), "left")
        hit = reduce(lambda a, b: a | b, (F.col(f"_r_{c}").isNotNull() for c in columns))
        moved = df.where(hit).select(*[F.coalesce(f"_r_{c}", c).alias(f"n_{c}") for c in columns], *self.keys, *([] if "out" in columns else ["out"]), "_e")
        moved, facts = self.space.measured(moved, "moved", few, fresh=F.col("_e") == epoch)
        if not facts["n"]:
            return None
        self._kill(moved, facts["n"], facts["fresh"], epoch, min(p.number for p in some), facts["table"])
        if columns == ["out"]:
            # inputs stay, so no row can meet another: what was written is the part
            local = facts["table"]
            self._append(moved.select(*self.keys, F.col("n_out").alias("out")), facts["n"], epoch, None if local is None else local.select([*self.keys, "n_out"]).rename_columns([*self.keys, "out"]))
            return None
        return moved.select(*[F.col(f"n_{c}").alias(c) if c in columns else F.col(c) for c in (*self.keys, "out")])
