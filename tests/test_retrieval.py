import random

import pytest

from shardloom.errors import InvalidArgument, NotFound
from shardloom.operators import retrieval as R

CHILD = "index_name string, shard_number int, child_chunk_id long, parent_chunk_id long, embedding array<float>"
PARENT = "index_name string, shard_number int, parent_chunk_id long, document_id string, chunk_index int, content string"


def query(spark, *v):
    return spark.createDataFrame([(list(map(float, v)),)], "q array<float>")


def run(spark, children, parents, k=10, t=None):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    scored = R.score_exact(c, query(spark, 0, 0), ("index_name", "shard_number", "child_chunk_id"))
    return [(r.document_id, r.score) for r in R.retrieve(c, p, scored, k, t).collect()]


def test_two_shards_same_ids_and_missing_rows(spark):
    children = [("i", 0, 1, 1, [1.0, 0.0]), ("i", 1, 1, 1, [0.0, 2.0]), ("i", 0, 2, 1, [3.0, 0.0]), ("i", 0, 3, 9, [0.0, 0.0]), ("i", 0, 4, None, [0.0, 0.0]), ("i", 0, 5, 1, None), ("i", 0, 6, 1, [1.0])]
    parents = [("i", 0, 1, "a", 0, "A"), ("i", 1, 1, "b", 0, "B")]
    assert run(spark, children, parents) == [("a", 1.0), ("b", 4.0)]
    assert run(spark, children, parents, t=4.0) == [("a", 1.0), ("b", 4.0)]
    assert run(spark, children, parents, t=3.999) == [("a", 1.0)]
    assert run(spark, children, parents, k=0) == []
    with pytest.raises(InvalidArgument):
        R.top_by_shard(spark.range(1), ("id",), -1, ("id",))


def test_fewer_parents_than_children(spark):
    children = [("i", 0, n, 1, [float(n), 0.0]) for n in range(3)] + [("i", 0, 9, 2, [9.0, 0.0])]
    assert run(spark, children, [("i", 0, 1, "a", 0, ""), ("i", 0, 2, "b", 0, "")], k=3) == [("a", 0.0)]


def test_blocks_equal_exact(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.random() for _ in range(8)] if i % 17 else None) for i in range(400)]
    v = spark.createDataFrame(rows, "id int, s int, embedding array<float>").repartition(5)
    q = [float(x) for x in v.where("id = 1").first().embedding]
    exact = R.top_by_shard(R.score_exact(v, query(spark, *q), ("id", "s")), ("s",), 5, ("id",))
    fast = R.top_by_shard(R.score_blocks(v, q, ("id", "s"), 5, ("s",)), ("s",), 5, ("id",))
    clean = lambda df: {(r.id, r.s, round(r.score, 9)) for r in df.collect()}
    assert clean(exact) == clean(fast)


def test_live_rows(spark):
    rows = [(1, "old", "2025-01-01", None), (1, "new", "2025-01-02", None), (1, "gone", "2025-01-03", "2025-01-04"), (2, "x", "2025-01-01", "2025-01-02")]
    df = spark.createDataFrame(rows, "id int, v string, loaded_at string, deleted_at string")
    assert [(r.id, r.v) for r in R.live_rows(df, ("id",), ("v",)).collect()] == [(1, "new")]


def test_plan(spark, folder):
    from shardloom.plans.registry import QUERIES

    plan = QUERIES["knn_sharded"](spark, folder)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = QUERIES["retrieve"](spark, folder)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNull(deleted_at)" in plan
    read = QUERIES["kv_size"](spark, folder)._jdf.queryExecution().toString()
    assert "received_at" not in read.rsplit("ReadSchema", 1)[1]


def test_scores_before_versions(spark):
    """The live row hides older ones even where it can't be compared; vectors never reach a shuffle."""
    rows = [("i", 0, 1, 5, [1.0, 0.0], "2025-01-01", None), ("i", 0, 1, 6, [2.0, 0.0], "2025-01-02", None), ("i", 0, 2, 5, [0.0, 0.0], "2025-01-01", None), ("i", 0, 2, 5, None, "2025-01-02", None), ("i", 0, 3, 5, [3.0, 0.0], "2025-01-01", "2025-01-02")]
    df = spark.createDataFrame(rows, "index_name string, shard_number int, child_chunk_id long, parent_chunk_id long, embedding array<float>, loaded_at string, deleted_at string")
    got = R.score_live(df, query(spark, 0, 0), ("index_name", "shard_number", "child_chunk_id"), ("parent_chunk_id",)).collect()
    assert [(r.child_chunk_id, r.parent_chunk_id, r.score) for r in got] == [(1, 6, 4.0)]


def test_vectors_are_not_shuffled(spark, folder):
    from shardloom.plans.registry import QUERIES

    for name in ("retrieve", "retrieve_index", "knn_sharded", "knn_threshold", "knn_dedup_parent"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        below = [x for x in plan.split("Exchange hashpartitioning")[1:] if "embedding" in x.split("\n", 2)[1].split("[", 1)[-1]]
        assert "Exchange hashpartitioning" in plan and not below, name


def test_unknown_index(spark, folder):
    from shardloom.sources.tables import table

    with pytest.raises(NotFound):
        R.of_index(table(spark, folder, "indices"), "no such index", table(spark, folder, "parent_chunks"))
