"""The queries of the subpackage over whole tables."""

import pytest
from compare import duck_rows, spark_rows

from shardloom.llm import queries

COLUMNS = {
    "p1_found": {"document_id_a": "string", "document_id_b": "string"}, "p3_found": {"document_id": "string"}, "p5_found": {"vec_id_a": "bigint", "vec_id_b": "bigint"},
    "p6_found": {"doc_id": "bigint", "item_id": "bigint"}, "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, folder, name):
    df = queries.QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    got = spark_rows(df)
    assert got[1]
    if name in COLUMNS:
        assert len(set(got[1])) == len(got[1])
    if name in queries.SQL:
        assert got == duck_rows(duck, queries.SQL[name])
