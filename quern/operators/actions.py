"""Rule heads: from a DataFrame of bindings to contributions to tables and links between ids.

An id is minted without a join or a counter: it is the epoch and a digest of the function and its
inputs, so it is the same whenever a lost task is run again, and an id of an earlier epoch is
smaller. If the inputs have an output already, the upsert finds both and links them,
the earlier id stays, and no trace of the new one is left when the rebuild is done.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.catalog import Catalog, spark_type
from quern.errors import ProgramError
from quern.functions.builtins import BUILTINS, check_arity
from quern.operators.store import FunctionTable
from quern.plans.query import literal
from quern.syntax import BASE_TYPES, INT, STRING, UNIT, Action, Call, Expr, Get, Int, Set, Str, Union, Unit, Var


def head_type(e: Expr, catalog: Catalog, variables: dict[str, str], where: str = "") -> str:
    """The type of an expression in a head, after checking it."""
    if isinstance(e, Var):
        if e.name not in variables:
            raise ProgramError(f"unknown variable {e}{where}")
        return variables[e.name]
    if not isinstance(e, Call):
        return {Int: INT, Str: STRING, Unit: UNIT}[type(e)]
    if e.name in BUILTINS:
        check_arity(e.name, len(e.args), e)
        kinds, output = [INT] * len(e.args), INT
    else:
        f = catalog.function(e.name)
        if len(e.args) != len(f.inputs):
            raise ProgramError(f"{e.name} has {len(f.inputs)} inputs, found {e}{where}")
        kinds, output = f.inputs, f.output
    for a, kind in zip(e.args, kinds, strict=True):
        if (found := head_type(a, catalog, variables, where)) != kind:
            raise ProgramError(f"expected {kind}, found {found} {a}{where}")
    return output


def check_action(action: Action, catalog: Catalog, variables: dict[str, str]) -> None:
    where = f" in {action.where}" if action.where else ""
    if isinstance(action, Union):
        a, b = (head_type(e, catalog, variables, where) for e in (action.a, action.b))
        if a != b or a in BASE_TYPES:
            raise ProgramError(f"expected matching sorts{where}")
        return
    output = head_type(Call(action.name, action.args), catalog, variables, where)
    if isinstance(action, Set):
        if action.name in BUILTINS:
            raise ProgramError(f"unknown function {action.name}{where}")
        if (found := head_type(action.value, catalog, variables, where)) != output:
            raise ProgramError(f"expected {output}, found {found} {action.value}{where}")


def lookups(action: Action, catalog: Catalog) -> bool:
    """Whether the action reads outputs that can't be minted."""

    def inside(e: Expr, nested: bool) -> bool:
        if not isinstance(e, Call):
            return False
        own = nested and e.name not in BUILTINS and catalog.function(e.name).output in (INT, STRING)
        return own or any(inside(a, True) for a in e.args)

    if isinstance(action, Union):
        return inside(action.a, True) or inside(action.b, True)
    value = isinstance(action, Set) and inside(action.value, True)
    return value or any(inside(a, True) for a in action.args)


@dataclass
class Effects:
    """Contributions by function, and links by sort, of one iteration."""

    rows: dict[str, list[DataFrame]] = field(default_factory=lambda: defaultdict(list))
    links: dict[str, list[DataFrame]] = field(default_factory=lambda: defaultdict(list))


#: An id: the epoch and a digest, of 104 bits; among 10^9 ids of one epoch two are the same with a chance of 3 in 10^14.
ID_BYTES, EPOCH_BYTES = 16, 3


def epoch_start(epoch: int) -> bytes:
    """What the ids of an epoch begin with."""
    return epoch.to_bytes(EPOCH_BYTES, "big")


class Head:
    """Runs actions over bindings whose columns are the variables."""

    def __init__(self, catalog: Catalog, tables: dict[str, FunctionTable], epoch: int):
        self.catalog, self.tables, self.epoch = catalog, tables, epoch

    def run(self, actions: tuple[Action, ...], bindings: DataFrame, variables: dict[str, str], rule: int, effects: Effects) -> None:
        ordered = any(not isinstance(a, Union) and self.tables[a.name].merge.ordered for a in actions)
        order = self._order(bindings) if ordered else F.lit("")
        for k, action in enumerate(actions):
            df = bindings
            if isinstance(action, Union):
                kind = head_type(action.a, self.catalog, variables)
                df, a = self._value(action.a, df, effects)
                df, b = self._value(action.b, df, effects)
                effects.links[kind].append(df.select(a.alias("a"), b.alias("b")).where("a <> b"))
                continue
            args = []
            for e in action.args:
                df, c = self._value(e, df, effects)
                args.append(c)
            f = self.catalog.function(action.name)
            if isinstance(action, Set):
                df, out = self._value(action.value, df, effects)
            elif f.output in (INT, STRING):
                continue  # nothing can be made up
            else:
                out = self._mint(f.name, f.output, args)
            self._give(f.name, df, args, out, effects, F.concat(F.lit(f"{rule:06d}{k:04d}"), order))

    def give_literals(self, facts: list[tuple[int, Get | Set]], effects: Effects) -> None:
        """Facts (number, action) of one function, without calls inside, as one table."""
        name = facts[0][1].name
        table = self.tables[name]
        spark = table.space.spark
        value = lambda e: True if isinstance(e, Unit) else e.value
        rows = [(f"{k:06d}", *map(value, a.args), value(a.value) if isinstance(a, Set) else None) for k, a in facts]
        kinds = [spark_type(kind).simpleString() for kind in table.kinds]
        names = [*table.keys, "out"]
        df = spark.createDataFrame(rows, ", ".join(["ord string", *(f"{n} {kind}" for n, kind in zip(names, kinds, strict=True))]))
        args = [F.col(c) for c in table.keys]
        out = F.col("out") if isinstance(facts[0][1], Set) else self._mint(name, table.f.output, args)
        self._give(name, df, args, out, effects, F.col("ord"))

    def _give(self, name: str, df: DataFrame, args: list[Column], out: Column, effects: Effects, order: Column) -> None:
        columns = [c.alias(f"c{i}") for i, c in enumerate(args)] + [out.alias("out")]
        if self.tables[name].merge.ordered:
            columns.append(order.alias("ord"))
        effects.rows[name].append(df.select(*columns))

    def _mint(self, name: str, output: str, args: list[Column]) -> Column:
        if output == UNIT:
            return F.lit(True)
        texts = [c.cast("string") if kind in BASE_TYPES else F.hex(c) for c, kind in zip(args, self.catalog.function(name).inputs, strict=True)]
        parts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]
        digest = F.md5(F.concat(F.lit(name + "("), *parts))
        return F.unhex(F.concat(F.lit(epoch_start(self.epoch).hex()), F.substring(digest, 1, 2 * (ID_BYTES - EPOCH_BYTES))))

    def _value(self, e: Expr, df: DataFrame, effects: Effects) -> tuple[DataFrame, Column]:
        if isinstance(e, Var):
            return df, F.col(f"`{e.name}`")
        if not isinstance(e, Call):
            return df, literal(e)
        args = []
        for a in e.args:
            df, c = self._value(a, df, effects)
            args.append(c)
        if e.name in BUILTINS:
            return df, BUILTINS[e.name].column(args)
        f = self.catalog.function(e.name)
        if f.output not in (INT, STRING):
            out = self._mint(f.name, f.output, args)
            self._give(f.name, df, args, out, effects, F.lit("9"))
            return df, out
        # a lookup: rows of bindings with the output there; one that is missing is an error when it is read
        table = self.tables[e.name]
        name = f"_v{len(df.columns)}"
        keys = [f"_k{len(df.columns)}_{i}" for i in range(len(args))]
        df = df.withColumns(dict(zip(keys, args, strict=True))) if keys else df
        rows = table.rows().select(*[F.col(c).alias(k) for c, k in zip(table.keys, keys, strict=True)], F.col("out").alias(name))
        df = df.join(rows, keys, "left") if keys else df.join(rows, F.lit(True), "left")
        missing = F.raise_error(F.lit(f"unknown value {e}")).cast("long" if f.output == INT else "string")
        return df.withColumn(name, F.when(F.col(name).isNull(), missing).otherwise(F.col(name))), F.col(name)

    @staticmethod
    def _order(df: DataFrame) -> Column:
        """A string that sorts as the binding columns do."""
        parts = []
        for name, kind in df.dtypes:
            c = F.col(f"`{name}`")
            if kind == "bigint":
                c = F.lpad((c.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
            elif kind == "binary":
                c = F.hex(c)
            parts += [c.cast("string"), F.lit("\x00")]
        return F.concat(F.lit(""), *parts)
