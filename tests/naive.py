"""A plain evaluator of programs on Python dictionaries: every rule on all rows in every round."""

from __future__ import annotations

import itertools

from quern import syntax as S
from quern.functions.builtins import BUILTINS


class Naive:
    def __init__(self):
        self.functions: dict[str, S.Function] = {}
        self.sorts: set[str] = set()
        self.tables: dict[str, dict[tuple, object]] = {}
        self.rules: list[S.Rule] = []
        self.parent: list[int] = []
        self.changed = False

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def execute(self, text: str, rounds: int = 50) -> None:
        for c in S.parse(text):
            if isinstance(c, S.Sort):
                self.sorts.add(c.name)
            elif isinstance(c, S.Function):
                self.functions[c.name], self.tables[c.name] = c, {}
            elif isinstance(c, S.Rule):
                self.rules.append(c)
            elif isinstance(c, S.Do):
                self.act(c.action, {})
                self.rebuild()
            elif isinstance(c, S.Run):
                for _ in range(rounds if c.limit is None else c.limit):
                    self.changed = False
                    found = [(r, self.match(r.body)) for r in self.rules]
                    for r, bindings in found:
                        for b in bindings:
                            for a in r.head:
                                self.act(a, b)
                    self.rebuild()
                    if not self.changed:
                        break

    def canonical(self, kind, v):
        return self.find(v) if kind in self.sorts else v

    def match(self, body):
        """All bindings, by trying the rows of each table call in turn."""
        calls: list[S.Call] = []

        def inner(e):
            if isinstance(e, S.Call):
                for a in e.args:
                    inner(a)
                if e.name not in BUILTINS and e not in calls:
                    calls.append(e)

        for p in body:
            for e in p.exprs:
                inner(e)
        if not calls:
            return []
        out = []
        for combo in itertools.product(*(list(self.tables[c.name].items()) for c in calls)):
            values = {c: y for c, (_, y) in zip(calls, combo, strict=True)}
            binding: dict[str, object] = {}
            facts = [(a, v) for c, (xs, _) in zip(calls, combo, strict=True) for a, v in zip(c.args, xs, strict=True)]
            equal = [p.exprs for p in body]
            if self.solve(facts, equal, values, binding):
                out.append(binding)
        return out

    def value(self, e, values, binding):
        if isinstance(e, S.Var):
            return binding.get(e.name)
        if isinstance(e, S.Call):
            if e in values:
                return values[e]
            args = [self.value(a, values, binding) for a in e.args]
            return None if None in args else BUILTINS[e.name].value(args)
        return () if isinstance(e, S.Unit) else e.value

    def solve(self, facts, equal, values, binding):
        """Bind variables until nothing is left; False if two values differ."""
        while True:
            progress, waiting = False, False
            pairs = [(e, lambda v=v: v) for e, v in facts]
            for es in equal:
                known = next((v for e in es if (v := self.value(e, values, binding)) is not None), None)
                if known is None:
                    waiting |= len(es) > 1
                else:
                    pairs += [(e, lambda v=known: v) for e in es]
            for e, v in pairs:
                now = self.value(e, values, binding)
                if now is None:
                    if isinstance(e, S.Var):
                        binding[e.name] = v()
                        progress = True
                    else:
                        waiting = True
                elif now != v():
                    return False
            if not progress:
                return not waiting

    def evaluate(self, e, binding):
        if isinstance(e, S.Call):
            args = [self.evaluate(a, binding) for a in e.args]
            return BUILTINS[e.name].value(args) if e.name in BUILTINS else self.get(e.name, args)
        return self.value(e, {}, binding)

    def get(self, name, args):
        f, t = self.functions[name], self.tables[name]
        key = tuple(self.canonical(k, v) for k, v in zip(f.inputs, args, strict=True))
        if key not in t:
            if f.output == S.UNIT:
                t[key] = ()
            elif f.output in self.sorts:
                self.parent.append(len(self.parent))
                t[key] = len(self.parent) - 1
            else:
                return None
            self.changed = True
        return t[key]

    def put(self, name, key, y):
        f, t = self.functions[name], self.tables[name]
        key = tuple(self.canonical(k, v) for k, v in zip(f.inputs, key, strict=True))
        y = self.canonical(f.output, y)
        old = t.get(key)
        if old is None:
            t[key] = y
            self.changed = True
        elif f.merge is not None:
            t[key] = self.evaluate(f.merge, {"old": old, "new": y})
            self.changed |= t[key] != old
        elif f.output in self.sorts:
            self.join(old, y)
        else:
            assert old == y

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.parent[b] = a
            self.changed = True

    def act(self, a, binding):
        if isinstance(a, S.Union):
            self.join(self.evaluate(a.a, binding), self.evaluate(a.b, binding))
        elif isinstance(a, S.Set):
            self.put(a.name, [self.evaluate(x, binding) for x in a.args], self.evaluate(a.value, binding))
        else:
            self.get(a.name, [self.evaluate(x, binding) for x in a.args])

    def rebuild(self):
        again = True
        while again:
            again = False
            for name, f in self.functions.items():
                t = self.tables[name]
                rows = [(tuple(self.canonical(k, v) for k, v in zip(f.inputs, xs, strict=True)), self.canonical(f.output, y), xs, y) for xs, y in t.items()]
                if all(a == xs and b == y for a, b, xs, y in rows):
                    continue
                again = True
                for a, b, xs, y in rows:
                    if (a, b) != (xs, y):
                        del t[xs]
                for a, b, xs, y in rows:
                    if (a, b) != (xs, y):
                        self.put(name, a, b)

    def state(self):
        """What can be compared: rows of functions without sorts, sizes of all, and classes by their terms of base values."""
        plain = {n: sorted(((*xs, y) for xs, y in t.items()), key=repr) for n, t in self.tables.items() if not {*self.functions[n].inputs, self.functions[n].output} & self.sorts}
        sizes = {n: len(t) for n, t in self.tables.items()}
        classes = {}
        for n, t in self.tables.items():
            f = self.functions[n]
            if f.output in self.sorts and not set(f.inputs) & self.sorts:
                for xs, y in t.items():
                    classes.setdefault((f.output, self.find(y)), []).append((n, *xs))
        return plain, sizes, sorted(sorted(c, key=repr) for c in classes.values())


def state_of(program):
    """The same of a program on Spark."""
    sorts = set(program.catalog.sorts)
    plain, sizes, classes = {}, {}, {}
    for n, t in program.tables.items():
        f = t.f
        sizes[n] = program.size(n)
        rows = program.table(n).collect()
        assert sizes[n] == len(rows) == len({tuple(r)[:-1] for r in rows})
        if not {*f.inputs, f.output} & sorts:
            plain[n] = sorted(((*tuple(r)[:-1], () if f.output == S.UNIT else r["out"]) for r in rows), key=repr)
        if f.output in sorts and not set(f.inputs) & sorts:
            for r in rows:
                classes.setdefault((f.output, r["out"]), []).append((n, *tuple(r)[:-1]))
    return plain, sizes, sorted(sorted(c, key=repr) for c in classes.values())
