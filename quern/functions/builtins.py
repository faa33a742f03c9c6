"""Built-in scalar functions: one registry from name to arity and Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import ProgramError


@dataclass(frozen=True)
class Builtin:
    """A function of any number of integers; value works on numbers, column on Columns."""

    least_args: int
    column: Callable[[Sequence[Column]], Column]
    value: Callable[[Sequence[int]], int]


def _least(args: Sequence[Column]) -> Column:
    # least() passes over nulls and wants two arguments at least
    if len(args) == 1:
        return args[0]
    known = reduce(lambda a, b: a & b, (a.isNotNull() for a in args))
    return F.when(known, F.least(*args))


#: Sums and products raise an error on overflow, as Spark's ANSI mode does.
BUILTINS = {
    "+": Builtin(0, lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0).cast("long")), sum),
    "*": Builtin(0, lambda xs: reduce(lambda a, b: a * b, xs, F.lit(1).cast("long")), lambda xs: reduce(lambda a, b: a * b, xs, 1)),
    "min": Builtin(1, _least, min),
}


def check_arity(name: str, n: int, shown: object) -> None:
    if n < BUILTINS[name].least_args:
        raise ProgramError(f"need at least one argument for {shown}")
