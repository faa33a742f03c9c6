"""Queries of the subpackage beside their SQL, on the smallest tables and on rows of every odd kind."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.llm import queries
from tests.compare import compare

ROWS = [
    (1, "one two three four five six", "a"),
    (2, "one two three four five six", "a"),
    (2, "One two three four five six", "b"),
    (2, "One two three four five six", "b"),
    (3, None, "b"),
    (4, "", None),
    (5, "grüße 東京 🙂 " * 40, None),
    (None, "no id", "ä"),
    (None, "no id", ""),
    (None, None, "Z"),
]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("rows", [ROWS, ROWS * 9, []], ids=["few", "repeated", "none"])
def test_sharding_of_odd_rows_equals_its_sql(spark, tmp_path, rows):
    ids, texts, sources = zip(*rows) if rows else ((), (), ())
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array(sources, pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    assert compare(spark, str(tmp_path), queries.op10_sharding, queries.oracle_sql()["op10_sharding"]) == ""
