"""Helpers that several operators use: stored tables, row keys, size-checked broadcasts, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import BROADCAST_ROWS, delete, shared_dir

#: Text is taken in pieces of about this many bytes and at most so many rows, so that a worker's arrays stay small.
PIECE_BYTES, PIECE_ROWS = 512 << 10, 1024


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what materialize has written, once nothing will read it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quern/" in folder:
                delete(df.sparkSession, folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Mark df, a stored table, for broadcasting if it has no more than that many rows, each counting for its weight if that is given; else leave the join to shuffle."""
    total = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= rows else df


def free_name(name: str, df: DataFrame) -> str:
    """name, or what makes it one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a binary column that tells every row from every other, and that column's name.

    A row read from a file is known by the digest of the file's path and its place there,
    which any later scan gives again. Rows of any other origin are stored once, with
    numbers. So rows without an id, with equal ids, or equal throughout stay apart.
    """
    name = free_name("_row", docs)
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRelation":
        try:
            place = F.lpad(F.hex(F.col("_metadata.row_index")), 16, "0")
            return docs.select("*", F.unhex(F.concat(F.md5("_metadata.file_path"), place)).alias(name)), name
        except AnalysisException:  # a source without these columns
            pass
    numbered = docs.withColumn(name, F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
    return materialize(numbered, "numbered"), name


def take_rows(docs: DataFrame, key: str, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of keyed docs whose key is among rows (key), or with left_anti not among them; the key column goes."""
    rows = materialize(rows.select(key).distinct(), "rows")
    return docs.join(small(rows, BROADCAST_ROWS // 4), key, how).drop(key)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of up to `rows` rows with about `most` bytes of text; a longer row is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by key: each holds every row of the keys it has, several keys at once."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)
