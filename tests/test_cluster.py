import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument
from shardloom.operators import cluster as C
from shardloom.operators import tasks


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "address string")


@pytest.mark.parametrize("names,backups", [((), 1), (("a",), 1), (("b", "a"), 1), (("c", "a", "b"), 2), (("a", "b"), 3), (("a", "b"), 0)])
def test_assign(spark, names, backups):
    rows = C.assign(spark, nodes(spark, *names), 7, backups).orderBy("partition_id").collect()
    order = sorted(names)
    assert len(rows) == (7 if names else 0)
    for r in rows:
        p = r.partition_id
        assert r.owner == order[p % len(order)]
        assert r.backups == [x for x in (order[(p + i) % len(order)] for i in range(1, backups + 1)) if x != r.owner]
    with pytest.raises(InvalidArgument):
        C.assign(spark, nodes(spark, "a"), 0)


def test_diff_ignores_removed(spark):
    table = lambda rows: spark.createDataFrame(rows, "partition_id int, owner string")
    got = C.assignment_diff(table([(0, "a"), (1, "a"), (9, "a")]), table([(0, "a"), (1, "b"), (2, "c")])).collect()
    assert {tuple(r) for r in got} == {(1, "a", "b"), (2, None, "c")}


def test_membership(spark):
    known = spark.createDataFrame([("a", "active"), ("b", "dead"), ("c", "active"), ("me", "active"), ("d", "dead")], "address string, state string")
    got = C.membership(known, nodes(spark, "a", "b", "n", "n"), "me")
    assert {tuple(r) for r in got.collect()} == {("b", "rejoined"), ("n", "joined"), ("c", "left")}


def test_dead_and_coordinator(spark):
    t = dt.datetime(2025, 1, 1)
    beats = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(seconds=1)), ("c", t + dt.timedelta(seconds=9))], "address string, ts timestamp")
    assert [r.address for r in C.dead_nodes(beats, F.lit("2025-01-01 00:00:16").cast("timestamp"), 15).collect()] == ["a"]
    assert C.coordinator(spark.createDataFrame([("b", "active"), ("a", "dead"), ("c", "active")], "address string, state string")).first().address == "b"


def test_quorum(spark):
    seen = spark.createDataFrame([(1, 1), (2, 4), (3, 2), (4, 1)], "at int, visible long")
    assert [r.ok for r in C.quorum_timeline(seen).orderBy("at").collect()] == [True, True, True, False]
    assert [r.ok for r in C.quorum_timeline(seen, True).orderBy("at").collect()] == [True, True, False, False]


def test_tasks(spark):
    sent = spark.createDataFrame([("a", '{"n": 1}'), ("b", "not json"), ("c", None), (None, "{}")], "routing_key string, message string")
    done = {r.routing_key: r for r in tasks.route(sent, C.assign(spark, nodes(spark, "n1", "n2")), lambda k, m: {"n": m["n"] + 1} if m else None).collect()}
    assert done["a"].response == '{"n": 2}' and done["b"].status == "failed" and done["c"].response == "{}"
    assert done[None].error == "no owner"
    assert tasks.to_all(C.assign(spark, nodes(spark, "n1", "n2")), "{}", lambda k, m: None).count() == 2


def test_versions_and_promotion(spark):
    from shardloom.operators import cluster as C

    schema = "partition_id int, owner string, backups array<string>, version long"
    rows = [(0, "a", ["b"], 1), (0, "b", ["c"], 2), (0, "a", ["c"], 2), (1, "a", ["b", "c"], 5), (2, None, [], None)]
    table = C.newer(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in table.selectExpr("partition_id", "owner", "array_join(backups, ',')", "version").collect()} == {(0, "b", "c", 2), (1, "a", "b,c", 5)}
    dead = spark.createDataFrame([("a",), ("c",)], "address string")
    after = C.promote(table, dead)
    assert {tuple(r) for r in after.selectExpr("partition_id", "owner", "array_join(backups, ',')", "version").collect()} == {(0, "b", "", 3), (1, "b", "", 6)}
    same = C.next_version(table, table.drop("version"))
    assert {(r.partition_id, r.version) for r in same.collect()} == {(0, 2), (1, 5)}
    none = C.promote(table, spark.createDataFrame([("a",), ("b",), ("c",)], "address string"))
    assert all(r.owner is None and r.backups == [] for r in none.collect())


def test_topics(spark):
    import pytest

    from shardloom.errors import AlreadyExists, InvalidArgument
    from shardloom.operators.tasks import Topics

    topics = Topics()
    topics.listen("t", lambda key, message: {"n": message["n"] + 1})
    with pytest.raises(AlreadyExists):
        topics.listen("t", lambda key, message: None)
    with pytest.raises(InvalidArgument):
        topics.listen("", lambda key, message: None)
    table = spark.createDataFrame([(i, "a") for i in range(271)], "partition_id int, owner string")
    sent = spark.createDataFrame([("t", "k", '{"n": 1}'), ("u", "k", None)], "topic string, routing_key string, message string")
    assert {(r.status, r.response, r.error) for r in topics.route(sent, table).collect()} == {("completed", '{"n": 2}', None), ("failed", None, "no handler for topic u")}
    assert topics.unlisten("t") and not topics.unlisten("t")
