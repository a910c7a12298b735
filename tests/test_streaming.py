import datetime as dt
import random

from test_changelog import SCHEMA, as_dict, random_log, sequential
from test_locks import sequential as lock_model

from shardloom.operators.changelog import live_entries
from shardloom.sources.store import Store
from shardloom.streaming import changes as S

T0 = dt.datetime(2025, 1, 1)


def drain(df, tmp_path, mode):
    rows = {}

    def keep(batch, n):
        rows[n] = batch.collect()

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return [r for n in sorted(rows) for r in rows[n]]


def files(spark, rows, schema, path, parts=3):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_fold_equals_batch(spark, tmp_path):
    rows = random_log(11)
    stream = files(spark, rows, SCHEMA, tmp_path / "log")
    store = Store(spark, str(tmp_path / "store"))
    S.fold_stream(stream, store, str(tmp_path / "progress")).awaitTermination()
    assert store.version() == 3
    assert as_dict(live_entries(S.folded(store))) == sequential(rows)[0]
    again = Store(spark, str(tmp_path / "often"))
    S.fold_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), again, str(tmp_path / "other"), compact_every=2).awaitTermination()
    assert again.version() > 3 and as_dict(live_entries(S.folded(again))) == sequential(rows)[0]


def test_update_mode(spark, tmp_path):
    rows = [(1, "c", "k", s, op, str(s), None, None) for s, op in ((1, "put"), (3, "delete"), (2, "put"))]
    out = drain(S.latest_by_key(files(spark, rows, SCHEMA, tmp_path / "log")), tmp_path, "update")
    assert out[-1]["last"].seq == 3


def test_locks_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    events = [(i, rng.choice("ab"), rng.choice(["acquire", "release", "force"]), rng.choice("xy"), T0 + dt.timedelta(seconds=i)) for i in range(90)]
    schema = "seq long, key string, op string, owner string, ts timestamp"
    for i in range(3):
        spark.createDataFrame(events[i * 30 : i * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = {r.seq: (r.outcome, r.holder) for r in drain(S.lock_stream(stream, 5.0), tmp_path, "append")}
    assert got == {s: o[:2] for s, o in lock_model(events, 5.0).items()}


def test_bursts_and_silence(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "address string, ts timestamp"
    stream = files(spark, [("a", at(0)), ("b", at(4)), ("a", at(30)), ("b", at(500))], schema, tmp_path / "log", 4)
    out = drain(S.bursts(stream.selectExpr("ts", "left(address, 0) AS cluster"), "cluster", "10 seconds", "1 second"), tmp_path, "append")
    assert [(r.start, r.changes) for r in out] == [(at(0), 2), (at(30), 1)]
    (tmp_path / "two").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    dead = drain(S.heartbeats(stream, 15, "1 second"), tmp_path / "two", "append")
    assert "a" in {r.address for r in dead}


def test_bounded_equals_batch(spark, tmp_path):
    rows = [r for r in random_log(12) if r[4] == "put" and r[3] is not None and r[2] is not None]
    store = Store(spark, str(tmp_path / "store"))
    S.bounded_stream(files(spark, rows, SCHEMA, tmp_path / "log"), store, str(tmp_path / "progress"), 2).awaitTermination()
    last = {}
    for pid, col, key, seq, *_ in rows:
        last[pid, col, key] = max(seq, last.get((pid, col, key), seq))
    want = set()
    for scope in {k[:2] for k in last}:
        want |= {(*k, s) for k, s in sorted(((k, s) for k, s in last.items() if k[:2] == scope), key=lambda x: (-x[1], x[0][2]))[:2]}
    assert {tuple(r) for r in store.read("bounded").select("pid", "col", "key", "seq").collect()} == want


def test_expirations(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", 1, at(0), 5.0), ("b", 2, at(1), None), ("a", 3, at(10), 20.0), ("a", 4, at(20), 5.0), ("c", 5, at(21), 0.0), ("b", 6, at(22), 1.0), ("z", 7, at(500), 900.0)]
    schema = "key string, seq long, ts timestamp, ttl double"
    for part in (rows[:3], rows[3:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = drain(S.expirations(stream, "1 second"), tmp_path, "append")
    assert {(r.key, r.seq, r.expired_at) for r in out} == {("a", 1, at(5)), ("a", 4, at(25)), ("b", 6, at(23))}


def test_lock_timer(spark, tmp_path):
    schema = "seq long, key string, op string, owner string, ts timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    for part in ([(1, "a", "acquire", "x", at(0))], [(2, "b", "acquire", "y", at(100))], [(3, "b", "release", "y", at(101))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = drain(S.lock_stream(stream, 5.0, "1 second"), tmp_path, "append")
    assert {(r.seq, r.key, r.outcome, r.holder) for r in out} == {(1, "a", "granted", "x"), (None, "a", "expired", "x"), (2, "b", "granted", "y"), (3, "b", "released", None)}
