"""What happens when a function gets several outputs for the same inputs.

min, + and * of old and new, old and new themselves are recognised and become
aggregates with partial aggregation; any other expression is folded in order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import ProgramError
from quern.functions.builtins import BUILTINS, check_arity
from quern.syntax import INT, STRING, UNIT, Call, Expr, Function, Int, Str, Unit, Var

OLD, NEW = Var("old"), Var("new")


@dataclass(frozen=True)
class Merge:
    """kind: relation, same (outputs must agree), union, min, sum, product, first, last or fold."""

    kind: str
    expr: Expr | None = None

    @property
    def ordered(self) -> bool:
        return self.kind in ("first", "last", "fold")


def merge_of(f: Function, is_sort: bool) -> Merge:
    e = f.merge
    if e is None:
        return Merge("relation" if f.output == UNIT else "union" if is_sort else "same")
    _check(e, f)
    if e == OLD:
        return Merge("first", e)
    if e == NEW:
        return Merge("last", e)
    if isinstance(e, Call) and set(e.args) == {OLD, NEW} and len(e.args) == 2:
        return Merge({"min": "min", "+": "sum", "*": "product"}[e.name], e)
    return Merge("fold", e)


def _check(e: Expr, f: Function) -> None:
    kinds = {Int: INT, Str: STRING, Unit: UNIT}
    if isinstance(e, Call):
        if e.name not in BUILTINS:
            raise ProgramError(f"unknown function {e.name}")
        check_arity(e.name, len(e.args), e)
        if f.output != INT:
            raise ProgramError(f"expected {f.output}, found {e} in {f}")
        for a in e.args:
            _check(a, f)
    elif isinstance(e, Var):
        if e not in (OLD, NEW):
            raise ProgramError(f"unknown variable {e}")
    elif kinds[type(e)] != f.output:
        raise ProgramError(f"expected {f.output}, found {e} in {f}")


def fold_column(e: Expr, old: Column, new: Column) -> Column:
    """The merge expression over two Columns."""
    if isinstance(e, Call):
        return BUILTINS[e.name].column([fold_column(a, old, new) for a in e.args])
    if isinstance(e, Var):
        return old if e == OLD else new
    return F.lit(True if isinstance(e, Unit) else e.value)
