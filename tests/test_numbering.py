import random

from shardloom.operators.numbering import numbered


def test_numbers_within_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {}
    for r in numbered(df, ("k",), ("v",), "n").collect():
        got.setdefault(r.k, {})[r.n] = r.v
    for k, held in got.items():
        assert [held[i] for i in range(len(held))] == sorted(v for key, v in rows if key == k)
    assert sorted(r.n for r in numbered(df, (), ("v",), "n").collect()) == list(range(500))
    assert numbered(df.limit(0), ("k",), ("v",), "n").count() == 0
