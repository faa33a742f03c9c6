"""Tables in the folder that driver and executors share; writing one cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows of a few short columns; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of an intermediate table that the driver may keep.
LOCAL_ROWS = 5_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder, kept for the session; any other is refused, for its executors could not read one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """A folder of written tables, deleted as a whole by clear() or on leaving a with block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        self._n = 0

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:06d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.new_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, few: bool = False, **tests: Column) -> tuple[DataFrame, dict]:
        """The table, and its rows as n with how many of them pass each test, counted while it is written: no job of its own.

        few: the caller expects few rows. Up to LOCAL_ROWS of them are then kept by the driver
        as a local relation, which spares small iterations the files, and given as table too;
        more are written after all, and table is None.
        """
        if few:
            flags = {f"_is_{k}": F.coalesce(c, F.lit(False)) for k, c in tests.items()}
            table = df.withColumns(flags).limit(LOCAL_ROWS + 1).toArrow() if flags else df.limit(LOCAL_ROWS + 1).toArrow()
            if table.num_rows <= LOCAL_ROWS:
                facts = {k: pc.sum(table[f"_is_{k}"]).as_py() or 0 for k in tests}
                table = table.select(df.columns)
                return self.spark.createDataFrame(table, df.schema), {"n": table.num_rows, "table": table} | facts
        seen = Observation()
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in tests.items()]), name)
        return saved, {**seen.get, "table": None}

    def clear(self) -> None:
        """Delete all tables; nothing read from them works afterwards."""
        with suppress(Exception):
            delete(self.spark, self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()
