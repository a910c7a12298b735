import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument, QuorumLost
from shardloom.operators import cache as C

LOG = "pid int, col string, key string, seq long, op string, val string, ttl double, ts timestamp"
T0 = dt.datetime(2025, 1, 1)


def at(s):
    return F.lit((T0 + dt.timedelta(seconds=s)).isoformat(sep=" ")).cast("timestamp")


def log(spark, *rows):
    return spark.createDataFrame([(1, "c", k, seq, op, v, ttl, T0) for seq, op, k, v, ttl in rows], LOG)


def test_expiry(spark):
    state = C.replay(log(spark, (1, "put", "never", "v", 0.0), (2, "put", "none", "v", None), (3, "put", "ten", "v", 10.0)))
    found = lambda s: {r.key for r in state.where(C.alive(at(s), F.col("expires_at"))).collect()}
    assert found(9) == {"never", "none", "ten"} and found(10) == {"never", "none"}
    ttl = spark.range(1).select(C.expires_at(at(0), F.lit(None).cast("double"), 5.0).alias("e")).first().e
    assert ttl == T0 + dt.timedelta(seconds=5)


def test_versions(spark):
    state = C.replay(log(spark, (1, "put", "k", "a", None), (2, "put", "k", "b", 1.0), (3, "delete", "k", None, None), (4, "put", "k", "c", None), (5, "put", "k", "d", None)))
    assert [(r.val, r.version, r.seq) for r in state.collect()] == [("d", 2, 5)]
    again = C.replay(log(spark, (1, "put", "k", "a", 1.0), (2, "put", "k", "b", None)))
    assert again.first().version == 2  # expiry doesn't reset versions


def test_bulk(spark):
    state = C.replay(log(spark, (1, "put", "a", "1", None), (2, "put", "b", "2", None), (3, "put", "d", "4", 1.0)))
    keys = spark.createDataFrame([(1, "c", "a"), (1, "c", "a"), (1, "c", "z"), (1, "c", "d")], "pid int, col string, key string")
    assert {r.key for r in C.get_many(state, keys, at(5)).collect()} == {"a"}
    assert {(r.key, r.found) for r in C.exists_many(state, keys, at(5)).collect()} == {("a", True), ("z", False), ("d", False)}
    assert {r.key for r in C.delete_many(state, keys).collect()} == {"b"}
    batch = spark.createDataFrame([(1, "c", "a", "9", None), (1, "c", "n", "0", 3.0)], "pid int, col string, key string, val string, ttl double")
    got = {r.key: (r.val, r.version) for r in C.put_many(state, batch, at(7)).collect()}
    assert got == {"a": ("9", 2), "b": ("2", 1), "d": ("4", 1), "n": ("0", 1)}
    with pytest.raises(QuorumLost):
        C.put_many(state, batch, at(7), visible=1, expected=3)
    assert [r.key for r in C.get(state, "c", "a", at(0)).collect()] == ["a"]


def test_bound(spark):
    state = C.replay(log(spark, *[(i, "put", k, "v", None) for i, k in enumerate("abcd", 1)]))
    assert {r.key for r in C.bound(state, 2, ("seq",)).collect()} == {"c", "d"}
    with pytest.raises(InvalidArgument):
        C.bound(state, 0)


def test_quorum_even():
    assert [C.quorum(n) for n in (1, 2, 3, 4, 5)] == [1, 1, 2, 2, 3]
    assert C.quorum(4, strict_majority=True) == 3
    C.check_quorum(2, 4)
    with pytest.raises(QuorumLost):
        C.check_quorum(2, 4, strict_majority=True)


def test_checksums_and_compaction(spark):
    import zlib

    rows = [(1, "good", zlib.crc32(b"good")), (2, "bad", zlib.crc32(b"good")), (3, None, 0), (4, "", 0)]
    df = spark.createDataFrame(rows, "id int, p string, crc long")
    assert [r.id for r in C.checked(df, "p", "crc").collect()] == [1, 4]
    full = log(spark, (1, "put", "a", "1", None), (2, "put", "a", "2", None), (3, "put", "b", "3", None), (4, "delete", "b", None, None))
    short = C.compact(full)
    assert short.count() == 1
    assert {(r.key, r.val) for r in C.replay(short).collect()} == {("a", "2")}


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "pid int, v string")
    one, two = C.digest(a, ("pid",), ("v",)), C.digest(a.orderBy(F.desc("v")), ("pid",), ("v",))
    assert sorted(one.collect()) == sorted(two.collect())


def test_collections_and_partitions(spark):
    asked = spark.createDataFrame([(2, "a", 9.0, 9), (1, "a", 5.0, None), (3, "b", None, 2), (4, None, 1.0, 1)], "seq long, name string, default_ttl double, max_entries int")
    assert {tuple(r) for r in C.registry(asked).collect()} == {("a", 5.0, None), ("b", None, 2)}
    state = C.replay(log(spark, (1, "put", "a", "1", 5.0), (2, "put", "b", "2", None)))
    assert C.drop_collections(state, spark.createDataFrame([("c",)], "col string")).count() == 0
    other = state.where("key = 'a'").withColumn("version", F.lit(7).cast("long"))
    got = C.import_partitions(state, other).collect()
    assert [(r.key, r.version, r.ttl) for r in got] == [("a", 7, 5.0)]


def test_config():
    from shardloom.config import EngineConfig

    c = EngineConfig.from_dict({"root": "/x", "nodes": ["b", "a"]})
    assert c.nodes == ("b", "a") and c.cache_partitions == 271
    for bad in ({"root": ""}, {"root": "/x", "backups": -1}, {"root": "/x", "other": 1}):
        with pytest.raises(InvalidArgument):
            EngineConfig.from_dict(bad)


def test_reads_deletes_and_default_collection(spark):
    state = C.replay(log(spark, (1, "put", "a", "1", None), (2, "put", "b", "2", 1.0), (3, "put", "c", "3", None)))
    entry = "pid int, col string, key string"
    pid, col = state.select("pid", "col").first()
    reads = spark.createDataFrame([(pid, col, "a", 9), (pid, col, "b", 1), (pid, col, "no", 9), (pid, col, "c", None)], f"{entry}, seq long")
    assert {(r.key, r.last_access) for r in C.touched(state, reads).collect()} == {("a", 9), ("b", 2), ("c", 3)}
    keys = spark.createDataFrame([(pid, col, k) for k in ("a", "b", "no", "a")], entry)
    left, told = C.delete_one(state, keys, F.lit("2999-01-01").cast("timestamp"))
    assert {r.key for r in left.collect()} == {"c"} and {(r.key, r.deleted) for r in told.collect()} == {("a", True), ("b", False), ("no", False)}
    for call in (lambda: C.delete_many(state, keys, 1, 4), lambda: C.delete_one(state, keys, F.current_timestamp(), 1, 4), lambda: C.clear(state, keys, 1, 4)):
        with pytest.raises(QuorumLost):
            call()
    assert C.clear(state, keys).count() == 0
    named = C.in_collection(spark.createDataFrame([(None,), ("",), ("x",)], "col string"))
    assert [r.col for r in named.collect()] == ["default", "default", "x"]


def test_shared_folder(spark, monkeypatch):
    from shardloom.errors import InvalidArgument
    from shardloom.sources import scratch

    df = scratch.materialize(spark.range(3), "t")
    assert df.count() == 3 and spark.sparkContext.applicationId in scratch.own_dir(spark)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(InvalidArgument):
        scratch.shared_dir(Session)
