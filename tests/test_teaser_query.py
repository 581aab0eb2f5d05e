"""The teaser query on texts that the test tables do not hold."""

from __future__ import annotations

import __spark_entry__ as entry
from tests.oracle import compare, connect

NAME = "fn_16_teaser_cut"


def test_blank_texts_equal_sql(spark, tmp_path):
    texts = ["", " ", "\t\r\n\f", " Ein Fall \n", "...", "Ein Fall ...", "xq", None]
    rows = [(3 * i + k, text) for i, text in enumerate(texts) for k in range(3)]
    rows += [(-1 - i, text) for i, text in rows] + [(None, "Ein Fall")]
    folder = tmp_path / "documents"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder))
    tables = tmp_path / "tables"
    tables.mkdir()
    (file,) = folder.glob("*.parquet")
    (tables / "documents.parquet").write_bytes(file.read_bytes())
    result = compare(spark, connect(str(tables)), str(tables), NAME, entry.queries()[NAME], entry.oracle_sql()[NAME])
    assert result == ""
