import datetime as dt
import glob
import os

from shardloom.operators.cache import replay
from shardloom.sources import wal

SCHEMA = "seq long, ts timestamp, op string, pid int, col string, key string, val string, ttl double, extra string"
T = dt.datetime(2025, 1, 1, 0, 0, 0, 123456)


def log(spark, n):
    return spark.createDataFrame([(i, T, "put", 0, "c", f"k{i % 7}", "vä\n" * (i % 5), None, "x") for i in range(n)], SCHEMA)


def test_frames():
    raw = wal.frame(b"one") + wal.frame(b"two")[:-1] + b"X" + wal.frame(b"three")
    assert list(wal.frames(raw)) == [(b"one", True), (b"twX", False), (b"three", True)]
    assert list(wal.frames(raw[:-2])) == [(b"one", True), (b"twX", False), (None, False)]
    assert list(wal.frames(wal.frame(b"") + b"\0\0\0")) == [(b"", True), (None, False)] and list(wal.frames(b"")) == []


def test_append_scan_and_compact(spark, tmp_path):
    folder = str(tmp_path / "wal")
    assert wal.scan(spark, folder).count() == 0
    rows = log(spark, 100).repartition(2)
    first = wal.append(rows, folder, segment_bytes=1500)
    assert first > 4 and first == len(wal.segments(spark, folder))
    assert max(os.path.getsize(p) for p in glob.glob(f"{folder}/*.wal")) <= 1500
    more = wal.append(log(spark, 3), folder)
    back = wal.scan(spark, folder)
    assert back.count() == 103 and first + more == len(wal.segments(spark, folder))
    assert back.where("seq = 4").select("ts", "op", "key", "val").distinct().collect()[0][1:] == ("put", "k4", "vä\n" * 4)
    # a truncated tail ends its segment alone, a damaged record is skipped
    path = sorted(glob.glob(f"{folder}/*.wal"))[0]
    raw = open(path, "rb").read()
    whole = sum(ok for _, ok in wal.frames(raw))
    open(path, "wb").write(raw[:9] + b"?" + raw[10:-3])
    assert wal.scan(spark, folder).count() == 103 - 2 and whole > 2
    state = lambda df: {(r.key, r.seq, r.val) for r in replay(df.selectExpr("*", "timestamp_seconds(ts) AS t").drop("ts").withColumnRenamed("t", "ts")).collect()}
    before = state(wal.scan(spark, folder))
    wal.compact(spark, folder)
    assert state(wal.scan(spark, folder)) == before and wal.scan(spark, folder).count() == 7
