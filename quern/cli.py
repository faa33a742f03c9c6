"""python -m quern.cli FILE: run a program file and print what it prints."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quern.errors import ProgramError
from quern.program import Program
from quern.sources.programs import read_program


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """0 even if a check fails, which prints its failure; errors go to stderr, with 1."""
    try:
        if not args:
            raise ProgramError("usage: pass a program file")
        text = read_program(args[0])
        spark = spark or SparkSession.builder.appName("quern").getOrCreate()
        program = Program(spark)
        try:
            for line in program.execute(text, args[0]):
                print(line)
        finally:
            program.close()
    except ProgramError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
