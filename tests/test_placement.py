import hashlib

from pyspark.sql import functions as F

from shardloom.functions.placement import partition_of, shard_name, shard_of


def test_formulas(spark):
    rows = [("kb", f"doc-{i}", i % 9 + 1) for i in range(50)] + [("kb", "d", 0), ("kb", "d", None), (None, "d", 3)]
    df = spark.createDataFrame(rows, "i string, d string, n int")
    for r in df.select("*", shard_of(F.col("i"), F.col("d"), F.col("n")).alias("s"), partition_of(F.col("d")).alias("p")).collect():
        want = int(hashlib.sha256(f"{r.i}/{r.d}".encode()).hexdigest(), 16) % r.n if r.n and r.i else None
        assert r.s == want
        assert r.p == int.from_bytes(hashlib.md5(r.d.encode()).digest()[:4], "big") % 271


def test_name(spark):
    assert spark.range(1).select(shard_name(F.lit("kb"), F.lit(7))).first()[0] == "kb_000007"
