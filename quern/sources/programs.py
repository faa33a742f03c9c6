"""Program files and tables of facts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import ProgramError


def read_program(path: str) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ProgramError(f"could not read {path}") from e


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """Money as integer cents; programs have no floats."""
    return F.round(F.col(column) * 100).cast("long")


def units(column: str) -> Column:
    return F.col(column).cast("long")
