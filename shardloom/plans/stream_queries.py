"""Queries that run Structured Streaming over a table until all of it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.changelog import live_entries
from shardloom.plans.change_queries import P2_SQL
from shardloom.plans.cluster_queries import HOLD_S, LOCKS_SQL, lock_requests
from shardloom.sources.scratch import own_dir
from shardloom.sources.store import Store
from shardloom.sources.tables import table
from shardloom.streaming import changes as S


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # a folder of part files is read as it is; a single file by its name
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drained(df: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """All that a streaming plan sends on, as a table."""
    root = _root(spark)
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def kv_stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The live entries, folded by a stream into a table of the store."""
    root = _root(spark)
    store = Store(spark, f"{root}/store")
    S.fold_stream(_stream(spark, folder, "kv_log"), store, f"{root}/progress", payload=()).awaitTermination()
    if not store.version():
        return table(spark, folder, "kv_log").limit(0).select("pid", "col", "key", "seq")
    return live_entries(S.folded(store, payload=())).select("pid", "col", "key", "seq")


def kv_stream_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 keys of each partition and collection that were put last, deletes left aside."""
    root = _root(spark)
    store = Store(spark, f"{root}/store")
    S.bounded_stream(_stream(spark, folder, "kv_log"), store, f"{root}/progress", 3).awaitTermination()
    if not store.version():
        return table(spark, folder, "kv_log").limit(0).select("pid", "col", "key", "seq")
    return store.read("bounded")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_expirations(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of users that expired: an event puts its user's entry with up to two days to live."""
    ttl = ((F.col("event_id") % 48) * 3600).cast("double").alias("ttl")
    puts = _events(spark, folder).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", ttl)
    return _drained(S.expirations(puts), spark).select("key", "seq", F.unix_millis("expired_at").alias("expired_ms"))


def stream_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of signups and errors with less than ten minutes between them, as far as the watermark closes them."""
    changes = _events(spark, folder).where(F.col("event_type").isin("signup", "error")).select("ts", F.lit("all").alias("cluster"))
    out = _drained(S.bursts(changes, "cluster", "10 minutes"), spark)
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "changes")


def stream_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Users that were silent for six hours until the watermark."""
    beats = _events(spark, folder).select(F.col("user_id").cast("string").alias("address"), "ts")
    out = _drained(S.heartbeats(beats, 6 * 3600), spark)
    return out.groupBy("address").agg(F.max(F.unix_millis("at")).alias("at_ms"))


def stream_locks(spark: SparkSession, folder: str) -> DataFrame:
    """What each lock event did, in a stream."""
    return _drained(S.lock_stream(lock_requests(_events(spark, folder)), HOLD_S), spark)


QUERIES = {f.__name__: f for f in (kv_stream_fold, kv_stream_bounded, stream_expirations, stream_bursts, stream_heartbeats, stream_locks)}
_MARK = "m AS (SELECT epoch_us(max(ts)) // 1000 - 60000 AS mark FROM events)"
SQL = {
    "kv_stream_fold": P2_SQL.format(more=""),
    "kv_stream_bounded": "SELECT * FROM (SELECT pid, col, key, max(seq) AS seq FROM kv_log WHERE seq IS NOT NULL AND op = 'put' AND key IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pid, col ORDER BY seq DESC, key) <= 3",
    "stream_expirations": f"WITH {_MARK}, e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, epoch_us(ts) // 1000 AS t, (event_id % 48) * 3600000 AS ttl, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT key, seq, t + ttl AS expired_ms FROM e, m WHERE ttl > 0 AND t + ttl <= coalesce(next, mark - 1)",
    "stream_bursts": "WITH x AS (SELECT epoch_us(max(ts)) - 60000000 AS mark FROM events WHERE event_type IN ('signup', 'error')), e AS (SELECT epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY ts) AS l FROM events WHERE event_type IN ('signup', 'error')), g AS (SELECT t, sum(CASE WHEN l IS NULL OR t - l > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT min(t) AS start_us, max(t) + 600000000 AS end_us, count(*) AS changes FROM g, x GROUP BY s, mark HAVING max(t) + 600000000 <= mark",
    "stream_heartbeats": f"WITH {_MARK} SELECT user_id::VARCHAR AS address, epoch_us(max(ts)) // 1000 + 21600000 AS at_ms FROM events, m GROUP BY user_id, mark HAVING epoch_us(max(ts)) // 1000 + 21600001 < mark",
    "stream_locks": f"WITH RECURSIVE {LOCKS_SQL} SELECT seq, key, outcome, holder FROM l",
}
