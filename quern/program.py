"""A program: declarations, facts and rules over tables, run to fixpoint on Spark."""

from __future__ import annotations

import time
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import syntax as S
from quern.catalog import Catalog, spark_type
from quern.errors import ProgramError
from quern.functions.merges import merge_of
from quern.operators.actions import Effects, Head, check_action, epoch_start, lookups
from quern.operators.closure import DERIVED, MOST_PAIRS, THERE, Closure, closure_of, compose
from quern.operators.components import BROADCAST_ROWS, DRIVER_LINKS, TASK_LINKS, roots
from quern.operators.store import FunctionTable
from quern.plans.query import Query, analyse, build, empty, union_all, variants
from quern.storage import LOCAL_ROWS, Workspace


@dataclass
class CompiledRule:
    rule: S.Rule
    query: Query
    number: int
    seen: bool = False  # whether it has been run on the rows of before it was declared
    closure: Closure | None = None
    closed: int = -1  # the last epoch whose rows are composed to the end

    @property
    def variables(self) -> dict[str, str]:
        return {n: self.query.type_of(n) for n in self.query.variables}


@dataclass
class RunReport:
    iterations: int = 0
    rows: int = 0
    seconds: float = 0.0
    by_iteration: list[tuple[int, float]] = field(default_factory=list)


class Program:
    """Functions, sorts and rules of one session.

    Rules see the tables as an iteration finds them; then all heads act, action by
    action, and ids that were linked are made one everywhere before the next iteration.
    An error in an iteration leaves the tables as they were before it.
    """

    def __init__(self, spark: SparkSession, max_rows: int | None = None, driver_links: int = DRIVER_LINKS, threads: int = 8, most_pairs: int = MOST_PAIRS, task_links: int = TASK_LINKS):
        self.spark, self.max_rows, self.driver_links, self.threads, self.most_pairs, self.task_links = spark, max_rows, driver_links, threads, most_pairs, task_links
        self.space = Workspace(spark)
        self.catalog = Catalog()
        self.tables: dict[str, FunctionTable] = {}
        self.rules: list[CompiledRule] = []
        self.epoch = self.lo = self.hi = 0
        self.batches: dict[tuple[str, str], int] = {}  # the last batch held of each stream
        self._facts: list[S.Action] = []
        self._started = time.perf_counter()

    # text

    def execute(self, text: str, name: str = "<program>") -> list[str]:
        """Run a program; the lines that it prints."""
        self._started = time.perf_counter()
        out: list[str] = []
        outputs = {f.name: f.output for f in self.catalog.functions.values()}
        for command in S.parse(text, name, outputs):
            out += self.command(command)
        self.flush()
        return out

    def command(self, c: S.Command) -> list[str]:
        if isinstance(c, S.Sort):
            self.catalog.add_sort(c.name)
        elif isinstance(c, S.Function):
            self.declare(c)
        elif isinstance(c, S.Rule):
            self.add_rule(c)
        elif isinstance(c, S.Do):
            self.do(c.action)
        elif isinstance(c, S.Run):
            self.run(c.limit)
        elif isinstance(c, S.Check):
            if not self.holds(c.body, c.where):
                return [f"failure: {c.where}", *self.dump(), ""]
        elif isinstance(c, S.PrintSize):
            return [f"Function {c.name} has size {self.size(c.name)}"]
        else:
            self.flush()
            return [f"Program has taken {self.stats()['seconds']:.3f}s"]
        return []

    def _read(self, text: str) -> list[S.Command]:
        return S.parse(text, outputs={f.name: f.output for f in self.catalog.functions.values()})

    # declarations

    def sort(self, name: str) -> None:
        self.catalog.add_sort(name)

    def declare(self, f: S.Function) -> None:
        self.catalog.add_function(f)
        self.tables[f.name] = FunctionTable(f, merge_of(f, self.catalog.is_sort(f.output)), self.space)

    def function(self, name: str, inputs: list[str], output: str, merge: str | None = None) -> None:
        e = None if merge is None else S.expr(S.read_lists(merge)[0])
        self.declare(S.Function(name, tuple(inputs), output, e))

    def relation(self, name: str, inputs: list[str]) -> None:
        self.declare(S.Function(name, tuple(inputs), S.UNIT))

    def datatype(self, sort: str, **variants: list[str]) -> None:
        self.sort(sort)
        for name, inputs in variants.items():
            self.function(name, inputs, sort)

    def rule(self, body: str, head: str) -> None:
        self.execute(f"(rule ({body}) ({head}))")

    def rewrite(self, a: str, b: str) -> None:
        self.execute(f"(rewrite {a} {b})")

    def let(self, name: str, value: str) -> None:
        self.execute(f"(let {name} {value})")

    def add_rule(self, rule: S.Rule) -> None:
        query = analyse(rule.body, self.catalog, rule.where)
        compiled = CompiledRule(rule, query, len(self.rules), closure=closure_of(rule.head, query, self.catalog))
        for a in rule.head:
            check_action(a, self.catalog, compiled.variables)
        if not query.atoms:
            warnings.warn(f"a rule without a call of a table never fires{f' in {rule.where}' if rule.where else ''}", stacklevel=2)
        self.rules.append(compiled)

    # facts

    def do(self, action: S.Action) -> None:
        """A top-level action; actions are gathered and done together, those that read outputs of the ones before after these."""
        check_action(action, self.catalog, {})
        if lookups(action, self.catalog):
            self.flush()
        self._facts.append(action)

    def set(self, call: str, value: str) -> None:
        self.execute(f"(set {call} {value})")

    def insert(self, call: str) -> None:
        self.execute(call)

    def union(self, a: str, b: str) -> None:
        self.execute(f"(union {a} {b})")

    def flush(self) -> None:
        if self._facts:
            facts, self._facts = self._facts, []
            effects = Effects()
            one = self.spark.range(1).select()
            head = Head(self.catalog, self.tables, self.epoch)
            plain: dict[tuple, list] = {}
            for k, a in enumerate(facts):
                if isinstance(a, S.Union) or any(map(_calls, _parts(a))):
                    head.run((a,), one, {}, k, effects)
                elif isinstance(a, S.Set) or self.catalog.function(a.name).output not in (S.INT, S.STRING):
                    plain.setdefault((a.name, type(a)), []).append((k, a))
            for group in plain.values():
                head.give_literals(group, effects)
            self._atomically(lambda: self._apply(effects, len(facts) <= LOCAL_ROWS))

    def load(self, name: str, df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None) -> None:
        """Add a row of the function for each row of df: columns are its inputs and, if it isn't a relation or into a sort, its output.

        Rows with a null in these columns can't be facts and are an error. For merges
        that depend on the order of arrival, order_by gives it, and ties go by the columns.
        Integers of any width become longs; other types must fit.
        """
        self.flush()
        f = self.catalog.function(name)
        kinds = list(f.inputs) + ([f.output] if f.output in (S.INT, S.STRING) else [])
        columns = columns or df.columns[: len(kinds)]
        if len(columns) != len(kinds):
            raise ProgramError(f"{name} takes {len(kinds)} columns, found {len(columns)}")
        for c, kind in zip(columns, kinds, strict=True):
            found = df.schema[c].dataType.typeName()
            if kind not in S.BASE_TYPES or (kind == S.INT) != (found in ("byte", "short", "integer", "long")) or (kind == S.STRING and found != "string"):
                raise ProgramError(f"expected {kind}, found {found} in column {c}")
        known = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in column {c} of {name}"))).otherwise(F.col(c)) if df.schema[c].nullable else F.col(c) for c in columns]
        names = [f"v{i}" for i in range(len(columns))]
        rows = df.select(*[F.col(c) for c in order_by or []], *[k.cast(spark_type(kind)).alias(n) for k, kind, n in zip(known, kinds, names, strict=True)]) if not order_by else df.withColumns({n: k.cast(spark_type(kind)) for k, kind, n in zip(known, kinds, names, strict=True)})
        head, table = Head(self.catalog, self.tables, self.epoch), self.tables[name]
        args = [F.col(n) for n in names[: len(f.inputs)]]
        out = F.col(names[-1]) if len(kinds) > len(f.inputs) else head._mint(name, f.output, args)
        picked = [a.alias(c) for a, c in zip(args, table.keys, strict=True)] + [out.alias("out")]
        if table.merge.ordered:
            picked.append(F.struct(*[F.col(c) for c in order_by or []], *map(F.col, names)).alias("ord"))
        effects = Effects()
        effects.rows[name].append(rows.select(*picked))
        self._atomically(lambda: self._apply(effects))

    # effects

    def _atomically(self, step) -> None:
        """Do a step; if it fails, the tables are as before."""
        kept = {n: t.state for n, t in self.tables.items()}
        try:
            step()
        except (ProgramError, PySparkException, Py4JJavaError) as e:
            for n, state in kept.items():
                self.tables[n].state = state
            raise (e if isinstance(e, ProgramError) else _told(e)) from e

    def _in_parallel(self, work: list) -> list:
        """Results of functions without arguments; Spark runs their jobs side by side, under the caller's job group."""
        if len(work) < 2:
            return [w() for w in work]
        with ThreadPoolExecutor(self.threads) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(w)) for w in work]]

    def _apply(self, effects: Effects, few: bool = False) -> None:
        """Upsert all contributions, then rebuild until no links are left. few: not many are expected."""
        rows, links = dict(effects.rows), {s: list(x) for s, x in effects.links.items()}
        while True:
            changes = self._in_parallel([lambda n=n, frames=frames: (n, self.tables[n].upsert(union_all(frames), self.epoch, few)) for n, frames in sorted(rows.items())])
            for name, change in changes:
                if change.links is not None:
                    links.setdefault(self.catalog.function(name).output, []).append(change.links)
            rows = {}
            for sort, frames in sorted(links.items()):
                for name, moved in self._rename(sort, frames, few):
                    rows.setdefault(name, []).append(moved)
            links = {}
            if not rows:
                return

    def _rename(self, sort: str, frames: list[DataFrame], few: bool) -> list[tuple[str, DataFrame]]:
        """Make linked ids one in all tables; the contributions that this takes out of them."""
        dirty, n, least = roots(union_all(frames), self.space, self.driver_links, self.task_links)
        if not n:
            return []
        if n <= BROADCAST_ROWS:
            dirty = F.broadcast(dirty)
        fresh_only = least >= epoch_start(self.epoch)
        affected = [t for _, t in sorted(self.tables.items()) if sort in t.kinds and t.parts]
        moved = self._in_parallel([lambda t=t: (t.f.name, t.rename(dirty, sort, self.epoch, fresh_only, few)) for t in affected])
        return [(name, df if not self.tables[name].merge.ordered else df.withColumn("ord", F.lit(""))) for name, df in moved if df is not None]

    # running

    def run(self, limit: int | None = None) -> RunReport:
        """Run all rules until nothing changes, or limit times."""
        self.flush()
        report, began = RunReport(), time.perf_counter()
        apart = limit is None and self._only_relations()
        for r in self.rules if apart else []:
            r.seen &= r.closure is None
        while limit is None or report.iterations < limit:
            start = time.perf_counter()
            n = self._iterate(apart)
            if apart and not n:
                n = self._close()
                if n is None:
                    apart, n = False, self._iterate()
            report.iterations += 1
            report.rows += n
            report.by_iteration.append((n, time.perf_counter() - start))
            if not n:
                break
        report.seconds = time.perf_counter() - began
        return report

    def _only_relations(self) -> bool:
        """Whether rules add rows to relations and do nothing else, so that the order in which they are run makes no difference."""
        plain = lambda a: isinstance(a, S.Get) and self.catalog.function(a.name).output == S.UNIT and not any(map(self._reads, a.args))
        return any(r.closure for r in self.rules) and all(plain(a) for r in self.rules for a in r.rule.head)

    def _reads(self, e: S.Expr) -> bool:
        return isinstance(e, S.Call) and (e.name in self.tables or any(map(self._reads, e.args)))

    def _close(self) -> int | None:
        """Run the rules that compose a relation with pairs to their end; how many rows that adds, or None if pairs are too many to be sent to all tasks."""
        total = 0
        for r in self.rules:
            if r.closure is None:
                continue
            c, hi = r.closure, self.epoch + 1
            path, step = self.tables[c.path], self.tables[c.step]
            news = path.count(r.closed + 1, hi), step.count(r.closed + 1, hi)
            if not path.live or not step.live or not any(news):
                continue
            if step.live > self.most_pairs:
                return None
            kept = self.epoch
            turned = lambda df, flip=c.flip: df.select(F.col("c1").alias("c0"), F.col("c0").alias("c1")) if flip else df.select("c0", "c1")

            def work(r=r, path=path, step=step, news=news, hi=hi, turned=turned) -> int:
                pairs = turned(step.rows())
                seeds, n, done = turned(path.rows(r.closed + 1, hi)).withColumn("kind", F.lit(THERE)), news[0], None
                if r.closed >= 0 and path.count(0, r.closed + 1):
                    done = turned(path.rows(0, r.closed + 1))
                    if news[1]:
                        # what was there meets the new pairs
                        late = turned(step.rows(r.closed + 1, hi)).select(F.col("c0").alias("c1"), F.col("c1").alias("to"))
                        late = F.broadcast(late) if news[1] <= BROADCAST_ROWS else late
                        more = done.join(late, "c1").select("c0", F.col("to").alias("c1"), F.lit(DERIVED).alias("kind"))
                        seeds, facts = self.space.measured(seeds.unionByName(more), "seeds")
                        n = facts["n"]
                return path.add(turned(compose(seeds, n, done, pairs)), self.epoch)

            self.epoch += 1
            try:
                added: list[int] = []
                self._atomically(lambda work=work, added=added: added.append(work()))
            except BaseException:
                self.epoch = kept
                raise
            # rows found are closed too, unless another rule composes the pairs
            r.closed = self.epoch
            total += added[0]
        self._check_size()
        return total

    def _iterate(self, apart: bool = False) -> int:
        """Run all rules once, or, apart, those that _close doesn't."""
        rules = [r for r in self.rules if not (apart and r.closure)]
        kept = self.lo, self.hi, self.epoch
        self.lo, self.hi = self.hi, self.epoch + 1
        self.epoch += 1
        effects = Effects()
        head = Head(self.catalog, self.tables, self.epoch)
        few = sum(t.count(self.lo if all(r.seen for r in rules) else 0, self.hi) for t in self.tables.values()) <= LOCAL_ROWS
        try:
            ready = self._in_parallel([lambda r=r: (r, self._bindings(r, few)) for r in rules])
            for r, bindings in ready:
                if bindings is not None:
                    head.run(r.rule.head, bindings, r.variables, r.number, effects)
            self._atomically(lambda: self._apply(effects, few))
        except BaseException as e:
            self.lo, self.hi, self.epoch = kept
            raise (_told(e) if isinstance(e, PySparkException | Py4JJavaError) else e) from e
        for r in rules:
            r.seen = True
        written = sum(t.count(self.epoch) for t in self.tables.values())
        self._check_size()
        return written

    def _check_size(self) -> None:
        if self.max_rows is not None and (total := sum(t.count() for t in self.tables.values())) > self.max_rows:
            raise ProgramError(f"tables have {total} rows; {self.max_rows} are allowed")

    def _bindings(self, r: CompiledRule, few: bool) -> DataFrame | None:
        """The new bindings of a rule: those with a row of the last range of epochs, each once; all, if the rule is new."""
        tables = [self.tables[a.name] for a in r.query.atoms]
        if not tables:
            return None  # a rule without a table atom never fires
        past = lambda t: (lambda: t.rows(0, self.lo), t.count(0, self.lo))
        new = lambda t: (lambda: t.rows(self.lo, self.hi), t.count(self.lo, self.hi))
        every = lambda t: (lambda: t.rows(0, self.hi), t.count(0, self.hi))
        if not r.seen:
            if not all(every(t)[1] for t in tables):
                return None
            df = build(r.query, [every(t) for t in tables], self.spark)
            frames = [df]
        else:
            counts = [(past(t)[1], new(t)[1]) for t in tables]
            frames = []
            for j in variants(counts):
                if all(c for i, c in enumerate(every(t)[1] for t in tables) if i > j):
                    sources = [past(t) if i < j else new(t) if i == j else every(t) for i, t in enumerate(tables)]
                    frames.append(build(r.query, sources, self.spark, first=j))
        if not frames:
            return None
        df = union_all(frames)
        # a head that uses the bindings more than once, or a join on their way, would work them out again
        uses = sum(1 + sum(map(_calls, _parts(a))) for a in r.rule.head)
        if uses > 1:
            if df.columns:
                df, facts = self.space.measured(df, "bindings", few)
                if not facts["n"]:
                    return None
        return df

    # questions

    def holds(self, body: tuple[S.Pattern, ...], where: S.Slice | None = None) -> bool:
        self.flush()
        return not self._answer(analyse(body, self.catalog, where)).limit(1).isEmpty()

    def _answer(self, query: Query) -> DataFrame:
        tables = [self.tables[a.name] for a in query.atoms]
        if not all(t.live for t in tables):
            return empty(query, self.spark)
        return build(query, [(lambda t=t: t.rows(), t.count()) for t in tables], self.spark)

    def check(self, text: str) -> bool:
        """Whether the patterns of a text hold together."""
        return self.holds(tuple(map(S.pattern, S.read_lists(text))))

    def query(self, text: str, select: list[str] | None = None) -> DataFrame:
        """The bag of bindings of the patterns of a text, one column for each variable. Ids of sorts are opaque."""
        self.flush()
        df = self._answer(analyse(tuple(map(S.pattern, S.read_lists(text))), self.catalog))
        return df.select(*[f"`{c}`" for c in select]) if select else df

    def table(self, name: str) -> DataFrame:
        """The rows of a function: c0, c1, ..., out."""
        self.flush()
        return self._table(name).rows().drop("_e")

    def _table(self, name: str) -> FunctionTable:
        if name not in self.tables:
            raise ProgramError(f"no function {name} in database")
        return self.tables[name]

    def size(self, name: str) -> int:
        self.flush()
        return self._table(name).count()

    def sizes(self) -> DataFrame:
        """(name, size) of all functions."""
        self.flush()
        return self.spark.createDataFrame([(n, t.count()) for n, t in sorted(self.tables.items())], "name string, size long")

    def stats(self) -> dict:
        return {"seconds": time.perf_counter() - self._started, "rows": {n: t.count() for n, t in sorted(self.tables.items())}}

    def dump(self) -> list[str]:
        """All rows as text, functions and rows in order; ids of sorts are numbered as they come."""
        self.flush()
        numbers: dict[str, int] = {}
        out = []
        for name, t in sorted(self.tables.items()):
            for row in t.rows().drop("_e").orderBy(*t.keys, "out").toLocalIterator():
                shown = []
                for v, kind in zip(row, t.kinds, strict=True):
                    if kind == S.UNIT:
                        shown.append("()")
                    elif kind in S.BASE_TYPES:
                        shown.append(str(S.Str(v) if kind == S.STRING else v))
                    else:
                        shown.append(f"s{numbers.setdefault(bytes(v), len(numbers))}")
                out.append(f"{name}: {' '.join(shown)}")
        return out

    def close(self) -> None:
        """Delete what the program has written. DataFrames from it can't be read any more."""
        self.space.clear()


def _parts(a: S.Action) -> list[S.Expr]:
    if isinstance(a, S.Union):
        return [a.a, a.b]
    return [*a.args, *([a.value] if isinstance(a, S.Set) else [])]


def _calls(e: S.Expr) -> int:
    return 1 + sum(map(_calls, e.args)) if isinstance(e, S.Call) else 0


def _told(e: BaseException) -> ProgramError:
    """What a failed job says, as a program's error."""
    text = str(e)
    for mark in ("unknown value", "null in column"):
        if mark in text:
            return ProgramError(reduce(lambda t, end: t.split(end)[0], ("\n", " SQLSTATE", "'"), text[text.index(mark) :]).strip())
    return ProgramError(text.split("\n")[0])
