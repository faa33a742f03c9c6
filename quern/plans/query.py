"""Conjunctive queries: from patterns to a plan of atoms and computed classes, and from that to a DataFrame.

Equal expressions form classes. Table calls become atoms over classes; calls with
the same arguments are the same atom, since inputs determine the output. Built-in
calls are computed as soon as their arguments are bound: they bind a class or filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog, spark_type
from quern.errors import ProgramError
from quern.functions.builtins import BUILTINS, check_arity
from quern.syntax import INT, STRING, UNIT, Call, Expr, Int, Pattern, Slice, Str, Unit, Var


@dataclass
class AtomPlan:
    name: str
    args: tuple[int, ...]
    out: int


@dataclass
class Computed:
    name: str
    args: tuple[int, ...]
    out: int


@dataclass
class Query:
    """Classes are numbered; names, types and constants are by class."""

    atoms: list[AtomPlan]
    computed: list[Computed]
    constants: dict[int, list[Expr]]
    names: dict[str, int]
    types: dict[int, str]
    where: Slice | None = None
    equal: set[int] = field(default_factory=set)

    @property
    def variables(self) -> list[str]:
        return sorted(self.names)

    def type_of(self, name: str) -> str:
        return self.types[self.names[name]]


class _Classes:
    def __init__(self) -> None:
        self.parent: list[int] = []

    def new(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def analyse(body: tuple[Pattern, ...], catalog: Catalog, where: Slice | None = None) -> Query:
    """Resolve and check a body. Raises ProgramError for unknown functions, wrong arity or types, two names for one value, and variables that nothing binds."""
    place = f" in {where}" if where else ""
    if not body:
        raise ProgramError(f"no patterns{place}")
    classes, names, constants = _Classes(), {}, {}
    atoms: list[AtomPlan] = []
    computed: list[Computed] = []

    def visit(e: Expr) -> int:
        if isinstance(e, Var):
            if e.name not in names:
                names[e.name] = classes.new()
            return names[e.name]
        if isinstance(e, Call):
            args = tuple(map(visit, e.args))
            out = classes.new()
            if e.name in BUILTINS:
                check_arity(e.name, len(args), e)
                computed.append(Computed(e.name, args, out))
            else:
                f = catalog.function(e.name)
                if len(args) != len(f.inputs):
                    raise ProgramError(f"{e.name} has {len(f.inputs)} inputs, found {e}{place}")
                atoms.append(AtomPlan(e.name, args, out))
            return out
        if e not in constants:
            constants[e] = classes.new()
        return constants[e]

    for p in body:
        first, *rest = map(visit, p.exprs)
        for x in rest:
            classes.union(first, x)

    def canonical(calls: list) -> list:
        """Calls of one function with the same arguments are one, and so are their outputs."""
        while True:
            seen, changed = {}, False
            for c in calls:
                key = (c.name, tuple(map(classes.find, c.args)))
                if key in seen:
                    changed |= classes.union(seen[key].out, c.out)
                else:
                    seen[key] = c
            if not changed:
                return [type(c)(c.name, tuple(map(classes.find, c.args)), classes.find(c.out)) for c in seen.values()]

    while True:
        mark = list(classes.parent)
        atoms, computed = canonical(atoms), canonical(computed)
        if mark == classes.parent:
            break

    types: dict[int, str] = {}

    def typed(c: int, kind: str, shown: object) -> None:
        if types.setdefault(classes.find(c), kind) != kind:
            raise ProgramError(f"expected {types[classes.find(c)]}, found {shown}{place}")

    for a in atoms:
        f = catalog.function(a.name)
        for c, kind in zip((*a.args, a.out), (*f.inputs, f.output), strict=True):
            typed(c, kind, f"{kind} of {a.name}")
    for b in computed:
        for c in (*b.args, b.out):
            typed(c, INT, f"{INT} of {b.name}")
    for e, c in constants.items():
        typed(c, {Int: INT, Str: STRING, Unit: UNIT}[type(e)], e)

    by_class: dict[int, str] = {}
    for name, c in names.items():
        other = by_class.setdefault(classes.find(c), name)
        if other != name:
            raise ProgramError(f"{other} and {name} refer to the same value{place}")
    values: dict[int, list[Expr]] = {}
    for e, c in constants.items():
        values.setdefault(classes.find(c), []).append(e)
    query = Query(atoms, computed, values, {n: classes.find(c) for n, c in names.items()}, types, where)
    bound = set(values) | {c for a in atoms for c in (*a.args, a.out)}
    _computable(query, bound)
    if not {c for b in computed for c in (*b.args, b.out)} | set(query.names.values()) <= bound:
        raise ProgramError(f"query was not range-restricted{place}")
    return query


def _computable(query: Query, bound: set[int]) -> None:
    """Add to bound what built-in calls bind."""
    while new := {b.out for b in query.computed if set(b.args) <= bound} - bound:
        bound |= new


def literal(e: Expr):
    if isinstance(e, Unit):
        return F.lit(True)
    return F.lit(e.value).cast("long") if isinstance(e, Int) else F.lit(e.value)


#: Where an atom's rows come from, and about how many they are.
Source = tuple[Callable[[], DataFrame], int]


def build(query: Query, sources: list[Source], spark: SparkSession, first: int | None = None) -> DataFrame:
    """The bag of bindings, one column for each variable. sources: for each atom; first: the atom to start from, as the one with the fewest rows."""
    used = [*(c for a in query.atoms for c in (*a.args, a.out)), *(c for b in query.computed for c in (*b.args, b.out)), *query.names.values()]
    wanted = {c for c in used if used.count(c) > 1} | set(query.names.values())
    bound: dict[int, object] = {c: literal(es[0]) for c, es in query.constants.items()}
    df: DataFrame | None = None
    if any(len(es) > 1 for es in query.constants.values()):
        df = spark.range(0).select()
    pending = list(query.computed)

    def compute() -> None:
        nonlocal df, pending
        progress = True
        while progress:
            progress, later = False, []
            for b in pending:
                if not set(b.args) <= bound.keys():
                    later.append(b)
                    continue
                progress = True
                value = BUILTINS[b.name].column([bound[c] for c in b.args])
                if b.out in bound:
                    df = (spark.range(1).select() if df is None else df).where(bound[b.out] == value)
                elif df is None:
                    bound[b.out] = value
                else:
                    df = df.withColumn(f"k{b.out}", value)
                    bound[b.out] = F.col(f"k{b.out}")
            pending = later

    def estimate(i: int) -> tuple[bool, float]:
        """Whether joining the atom may multiply rows, and about how many of its rows are left: each bound column is taken to keep a tenth."""
        a = query.atoms[i]
        known = [c in bound for c in a.args]
        return not (known and all(known)), sources[i][1] / 10.0 ** (sum(known) + (a.out in bound))

    compute()
    todo = list(range(len(query.atoms)))
    while todo:
        linked = [i for i in todo if df is not None and any(isinstance(c, int) and c in bound and c not in query.constants for c in (*query.atoms[i].args, query.atoms[i].out))]
        i = first if first in todo else min(linked or todo, key=estimate)
        todo.remove(i)
        df = _join(df, query.atoms[i], sources[i][0](), bound, wanted, query.constants)
        compute()
    if df is None:
        df = spark.range(1).select()
    return df.select(*[_as(bound[c], n) for n, c in sorted(query.names.items())])


def _as(column, name: str):
    return column.alias(name)


def _join(df: DataFrame | None, atom: AtomPlan, rows: DataFrame, bound: dict, wanted: set[int], constants: dict) -> DataFrame:
    """Join an atom's rows to df on the classes that both have; constants and repeated classes filter before the join."""
    columns: dict[int, str] = {}
    for i, c in enumerate((*atom.args, atom.out)):
        name = "out" if i == len(atom.args) else f"c{i}"
        if c in constants:
            rows = rows.where(F.col(name) == bound[c])
        elif c in columns:
            rows = rows.where(F.col(name) == F.col(columns[c]))
        elif c in wanted:
            columns[c] = name
    rows = rows.select(*[F.col(name).alias(f"k{c}") for c, name in columns.items()])
    if df is None:
        # values computed from constants alone
        early = [c for c in columns if c in bound]
        for c in early:
            rows = rows.where(F.col(f"k{c}") == bound[c])
        bound.update({c: F.col(f"k{c}") for c in columns})
        return rows
    shared = [c for c in columns if c in bound]
    plain = [c for c in shared if f"k{c}" in df.columns]
    for c in shared:
        if c not in plain:
            rows = rows.where(F.col(f"k{c}") == bound[c]).drop(f"k{c}")
    new = [c for c in columns if c not in shared]
    # a product is what the query asks for here: no value links the two sides
    out = df.join(rows, [f"k{c}" for c in plain], "inner") if plain else df.crossJoin(rows)
    bound.update({c: F.col(f"k{c}") for c in new})
    return out


def variants(counts: list[tuple[int, int]]) -> list[int]:
    """Which atoms may be the first with new rows, from (past, new) counts of each: others give nothing."""
    out = []
    for j, (_, new) in enumerate(counts):
        if new and all(past for past, _ in counts[:j]):
            out.append(j)
    return out


def empty(query: Query, spark: SparkSession) -> DataFrame:
    fields = ", ".join(f"`{n}` {spark_type(query.type_of(n)).simpleString()}" for n in query.variables)
    return spark.createDataFrame([], fields) if fields else spark.range(0).select()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
