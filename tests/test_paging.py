import pytest

from shardloom.errors import InvalidArgument
from shardloom.operators.paging import encode_token, keyset_page, sharded_page


def test_walk_over_shards(spark):
    rows = [(s, f"k{i:02d}") for s in (0, 1, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "s int, k string").repartition(3)
    for limit in (1, 4, 5, 7, 15, 99):
        seen, token = [], None
        while True:
            page = sharded_page(df, "s", "k", 4, token, limit)
            seen += [(r.s, r.k) for r in page.rows]
            if page.completed:
                assert page.next_offset is None
                break
            token = page.next_offset
        assert seen == sorted(rows)


def test_keyset(spark):
    df = spark.createDataFrame([(x,) for x in ("a", "b", "ü", "c")], "k string")
    page = keyset_page(df, "k", None, 2)
    assert [r.k for r in page.rows] == ["a", "b"] and not page.completed
    page = keyset_page(df, "k", page.next_offset, 2)
    assert [r.k for r in page.rows] == ["c", "ü"] and page.completed
    assert keyset_page(df.limit(0), "k", None, 2).completed


@pytest.mark.parametrize("token", ["x", "!!", encode_token(9, "k"), encode_token("a", "k"), encode_token(1)])
def test_bad_tokens(spark, token):
    df = spark.createDataFrame([(0, "a")], "s int, k string")
    with pytest.raises(InvalidArgument):
        sharded_page(df, "s", "k", 4, token, 2)


def test_limit(spark):
    with pytest.raises(InvalidArgument):
        keyset_page(spark.range(1), "id", None, 0)
