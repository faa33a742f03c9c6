"""Sorts and functions by name, and how their types map to Spark's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from quern.errors import ProgramError
from quern.functions.builtins import BUILTINS
from quern.syntax import BASE_TYPES, INT, STRING, UNIT, Function


def spark_type(kind: str) -> T.DataType:
    """Unit is a boolean that is true, integers are longs, members of sorts are bytes that only the engine makes."""
    return {UNIT: T.BooleanType(), INT: T.LongType(), STRING: T.StringType()}.get(kind, T.BinaryType())


@dataclass
class Catalog:
    sorts: dict[str, None] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)

    def add_sort(self, name: str) -> None:
        if name in self.sorts:
            raise ProgramError(f"{name} was declared twice")
        if name in BASE_TYPES:
            raise ProgramError(f"{name} is a type already")
        self.sorts[name] = None

    def add_function(self, f: Function) -> None:
        if f.name in self.functions:
            raise ProgramError(f"{f.name} was declared twice")
        if f.name in BUILTINS:
            raise ProgramError(f"{f.name} is built in")
        for kind in (*f.inputs, f.output):
            if kind not in BASE_TYPES and kind not in self.sorts:
                raise ProgramError(f"unknown sort {kind} in {f}")
        self.functions[f.name] = f

    def function(self, name: str) -> Function:
        if name not in self.functions:
            raise ProgramError(f"unknown function {name}")
        return self.functions[name]

    def is_sort(self, kind: str) -> bool:
        return kind in self.sorts
