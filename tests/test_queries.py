"""Every core query against its SQL, over whole tables."""

import pytest
from compare import duck_rows, spark_rows

from shardloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, folder, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, folder))
    assert columns
    if name in registry.SQL:
        assert (columns, rows) == duck_rows(duck, registry.SQL[name])


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
