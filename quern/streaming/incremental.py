"""Streams of facts into a program: each micro-batch is loaded and the rules are run on what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.program import Program


def stream_facts(program: Program, name: str, stream: DataFrame, columns: list[str], checkpoint: str, limit: int | None = None, once: bool = True) -> StreamingQuery:
    """Start a query that loads columns of a stream into a function and runs the rules after each batch.

    A batch that comes again after a failure is loaded once: the program remembers, for each
    function and checkpoint, the last batch that it holds, and loading one is all or nothing. That holds as long as the
    program does; a new program starts with a new checkpoint. once: stop when
    what is there has been read.
    """

    def batch(df: DataFrame, number: int) -> None:
        if number > program.batches.get((name, checkpoint), -1):
            program.load(name, df, columns)
            program.batches[name, checkpoint] = number
        program.run(limit)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
