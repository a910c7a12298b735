"""Key/value cache queries over the change log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.placement import partition_of
from shardloom.operators import cache as C
from shardloom.operators.changelog import fold_changes, live_entries
from shardloom.sources import wal
from shardloom.sources.scratch import materialize, own_dir
from shardloom.sources.tables import table

ENTRY = C.ENTRY
NOW = "2025-07-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "kv_log")


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return C.replay(_log(spark, folder))


def _named(spark: SparkSession, folder: str, *ops: str) -> DataFrame:
    """Keys that rows with these operations name; to the fold they are no changes."""
    return _log(spark, folder).where(F.col("op").isin(*ops) & F.col("key").isNotNull()).select(*ENTRY, "val", "ttl")


def kv_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries with versions and creation."""
    return _state(spark, folder).select(*ENTRY, "seq", "version", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def kv_put_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The last put or delete of each key, tombstones kept."""
    state = fold_changes(_log(spark, folder), payload=("val",))
    return state.where("key IS NOT NULL").select(*ENTRY, "seq", "op")


def kv_clear_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The last clear of each collection of a partition."""
    state = fold_changes(_log(spark, folder), payload=())
    return state.where("key IS NULL").select("pid", "col", "seq")


def kv_get(spark: SparkSession, folder: str) -> DataFrame:
    """The entry that was put last, read by its key. The fold sees only that key's rows and the clears."""
    log = _log(spark, folder)
    last = log.where("op = 'put' AND key IS NOT NULL").agg(F.max(F.struct("seq", "col", "key")).alias("k")).first()["k"]
    if last is None:
        return C.replay(log).select(*ENTRY, "val", "version")
    wanted = (F.col("col") == last["col"]) & ((F.col("key") == last["key"]) | (F.col("op") == "clear"))
    return C.get(C.replay(log.where(wanted)), last["col"], last["key"], _now()).select(*ENTRY, "val", "version")


def kv_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each key that `del` and `expire` rows name was there to be deleted."""
    return C.delete_one(_state(spark, folder), _named(spark, folder, "del", "expire"), _now())[1]


def kv_clear(spark: SparkSession, folder: str) -> DataFrame:
    """The state after all collections whose name begins with s are cleared, with three of four nodes in sight."""
    state = _state(spark, folder)
    return C.clear(state, state.where(F.col("col").startswith("s")).select("pid", "col"), visible=3, expected=4).select(*ENTRY, "seq")


def kv_lru_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 entries of each partition and collection that were put or read last; `touch` rows are reads."""
    reads = _log(spark, folder).where("op = 'touch' AND key IS NOT NULL").select(*ENTRY, "seq")
    used = materialize(C.touched(_state(spark, folder), reads), "used")
    return C.bound(used, 3, ("last_access",)).select(*ENTRY, "last_access")


def kv_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of each collection by the first change that names a ttl; calls without a name mean the default one."""
    asked = C.in_collection(_log(spark, folder).where("ttl IS NOT NULL"))
    return C.registry(asked.select("seq", F.col("col").alias("name"), F.col("ttl").alias("default_ttl"), F.col("pid").alias("max_entries")))


def kv_partition_import(spark: SparkSession, folder: str) -> DataFrame:
    """The state after its even partitions come back from a copy with doubled versions."""
    state = materialize(_state(spark, folder), "state")
    copy = state.where("pid % 2 = 0").withColumn("version", F.col("version") * 2)
    return C.import_partitions(state, copy).select(*ENTRY, "seq", "version")


def kv_drop_collections(spark: SparkSession, folder: str) -> DataFrame:
    """The state without the collections that `PUT` rows name."""
    names = _log(spark, folder).where("op = 'PUT'").select("col")
    return C.drop_collections(_state(spark, folder), names).select(*ENTRY, "seq")


def wal_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The change log written into segments and read back from their bytes, by operation."""
    root = f"{own_dir(spark)}/wal-{uuid.uuid4().hex}"
    wal.append(_log(spark, folder), root, 1 << 20)
    return wal.scan(spark, root).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def wal_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The entries that the log holds after its segments are compacted."""
    root = f"{own_dir(spark)}/wal-{uuid.uuid4().hex}"
    wal.append(_log(spark, folder), root, 1 << 20)
    wal.compact(spark, root)
    log = wal.scan(spark, root).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    return C.replay(log).select(*ENTRY, "seq", "val")


def kv_get_many(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the keys that `touch` rows name."""
    return C.get_many(_state(spark, folder), _named(spark, folder, "touch"), _now()).select(*ENTRY, "val")


def kv_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the keys that `touch` and `expire` rows name are there."""
    return C.exists_many(_state(spark, folder), _named(spark, folder, "touch", "expire"), _now())


def kv_put_many(spark: SparkSession, folder: str) -> DataFrame:
    """The state after a batch: what `PUT` rows hold."""
    return C.put_many(_state(spark, folder), _named(spark, folder, "PUT"), _now()).select(*ENTRY, "val", "version")


def kv_delete_many(spark: SparkSession, folder: str) -> DataFrame:
    """The state without the keys that `del` and `expire` rows name."""
    return C.delete_many(_state(spark, folder), _named(spark, folder, "del", "expire")).select(*ENTRY, "seq")


def kv_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are alive."""
    return _state(spark, folder).where(C.alive(_now(), F.col("expires_at"))).select(*ENTRY)


def kv_size(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries of each collection, over all partitions."""
    return kv_keys(spark, folder).groupBy("col").agg(F.count(F.lit(1)).alias("n"))


def kv_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Collections of each partition that ever held a change, and whether they hold an entry."""
    every = _log(spark, folder).groupBy("pid", "col").agg(F.count(F.lit(1)).alias("changes"))
    held = _state(spark, folder).select("pid", "col", F.lit(True).alias("held")).distinct()
    return every.join(held, ["pid", "col"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def kv_ttl_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Entries alive at a moment, with the seconds that they still have."""
    rows = _state(spark, folder).where(C.alive(_now(), F.col("expires_at")))
    return rows.select(*ENTRY, F.floor((F.unix_micros("expires_at") - F.unix_micros(_now())) / 1_000_000).alias("left_s"))


def kv_lru(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 entries of each partition and collection that were put last."""
    return C.bound(_state(spark, folder), 3, ("seq",)).select(*ENTRY, "seq")


def kv_partition_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The partition of every key by its hash."""
    keys = _log(spark, folder).where("key IS NOT NULL").select("key").distinct()
    return keys.withColumn("partition", partition_of(F.col("key")))


def kv_partition_export(spark: SparkSession, folder: str) -> DataFrame:
    """Live entries by partition, with everything that an import needs."""
    return _state(spark, folder).select(*ENTRY, "val", "ttl", "version")


def partition_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions whose backup differs: the backup missed what was received after May."""
    log = _log(spark, folder)
    backup = log.where("received_at < timestamp'2025-06-01 00:00:00'")
    sides = [C.digest(live_entries(fold_changes(x, payload=())), ("pid",), (*ENTRY, "seq")) for x in (log, backup)]
    theirs = sides[1].select(F.col("pid").alias("b"), F.col("entries").alias("backup_entries"), F.col("digest").alias("backup_digest"))
    both = sides[0].join(theirs, F.col("pid").eqNullSafe(F.col("b")), "full_outer")
    differs = ~F.col("digest").eqNullSafe(F.col("backup_digest"))
    return both.where(differs).select(F.coalesce("pid", "b").alias("pid"), F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("backup_entries", F.lit(0)).alias("backup_entries"))


def kv_backup_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every known key read from its partition, or from the backup where the partition doesn't hold it."""
    log = _log(spark, folder)
    primary = live_entries(fold_changes(log.where("received_at >= timestamp'2025-06-01 00:00:00'"), payload=()))
    backup = live_entries(fold_changes(log, payload=())).select(*[F.col(c).alias(f"b_{c}") for c in (*ENTRY, "seq")])
    both = primary.join(backup, [F.col(c) == F.col(f"b_{c}") for c in ENTRY], "full_outer")
    return both.select(*[F.coalesce(c, f"b_{c}").alias(c) for c in ENTRY], F.coalesce("seq", "b_seq").alias("seq"))


def kv_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The compacted log."""
    return C.compact(_log(spark, folder)).select("seq", "op", *ENTRY, "val", "ttl")


def wal_crc_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Records by operation after a check of the stored bytes; of records without operation a byte was damaged."""
    payload = F.concat_ws("|", F.coalesce("op", F.lit("")), "col", F.coalesce("key", F.lit("")), F.coalesce("val", F.lit(""))).cast("binary")
    damaged = F.when(F.col("op").isNull(), F.overlay("payload", F.lit(b"#"), 1)).otherwise(F.col("payload"))
    log = _log(spark, folder).withColumn("payload", payload).withColumn("crc", F.crc32("payload")).withColumn("payload", damaged)
    return C.checked(log, "payload", "crc").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


_CHANGES = """
x AS (SELECT seq, pid, col, CASE WHEN op <> 'clear' THEN key END AS key, max(struct_pack(op := op, val := coalesce(val, '\\x00'), ttl := coalesce(ttl, -1e300), ts := ts)) AS c FROM kv_log WHERE seq IS NOT NULL AND op IN ('put','delete','clear') AND (op = 'clear' OR key IS NOT NULL) GROUP BY ALL),
cl AS (SELECT pid, col, max(seq) AS cleared FROM x WHERE c.op = 'clear' GROUP BY ALL),
de AS (SELECT pid, col, key, max(seq) AS deleted FROM x WHERE c.op = 'delete' GROUP BY ALL),
pu AS (SELECT x.* FROM x LEFT JOIN cl USING (pid, col) LEFT JOIN de USING (pid, col, key) WHERE c.op = 'put' AND seq > greatest(coalesce(cleared, -1), coalesce(deleted, -1))),
st AS (SELECT pid, col, key, max(seq) AS seq, nullif(arg_max(c.val, seq), '\\x00') AS val, nullif(arg_max(c.ttl, seq), -1e300) AS ttl, count(*) AS version, arg_min(c.ts, seq) AS created_at, arg_max(c.ts, seq) AS updated_at FROM pu GROUP BY ALL),
state AS (SELECT *, CASE WHEN ttl > 0 THEN updated_at + to_microseconds(round(ttl * 1e6)::BIGINT) END AS expires_at FROM st),
live AS (SELECT * FROM state WHERE expires_at IS NULL OR TIMESTAMPTZ '2025-07-01 00:00:00+00' < expires_at)
"""
_FOLD = """{n}c AS (SELECT * FROM kv_log WHERE seq IS NOT NULL AND op IN ('put','delete','clear') AND (op = 'clear' OR key IS NOT NULL){where}),
{n}k AS (SELECT pid, col, key, max(seq) AS seq, arg_max(op, (seq, op)) AS op FROM {n}c WHERE op <> 'clear' GROUP BY ALL),
{n}x AS (SELECT pid, col, max(seq) AS cleared FROM {n}c WHERE op = 'clear' GROUP BY ALL),
{n} AS (SELECT {n}k.pid, {n}k.col, {n}k.key, {n}k.seq FROM {n}k LEFT JOIN {n}x USING (pid, col) WHERE op = 'put' AND (cleared IS NULL OR seq > cleared))"""
_A, _B, _L = (_FOLD.format(n=n, where=w) for n, w in (("a", ""), ("b", " AND received_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'"), ("l", " AND received_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00'")))


def _named_sql(*ops: str) -> str:
    return f"(SELECT DISTINCT pid, col, key FROM kv_log WHERE key IS NOT NULL AND op IN ({', '.join(repr(o) for o in ops)}))"


_DIGEST = "SELECT pid, count(*) AS n, sum(('0x' || substr(md5(concat_ws(chr(1), pid, col, key, seq)), 1, 8))::BIGINT) AS d FROM {} GROUP BY pid"
QUERIES = {f.__name__: f for f in (kv_replay, kv_put_fold, kv_clear_fold, kv_get, kv_delete, kv_clear, kv_lru_reads, kv_registry, kv_partition_import, kv_drop_collections, wal_scan, wal_compact, kv_get_many, kv_exists, kv_put_many, kv_delete_many, kv_keys, kv_size, kv_collections, kv_ttl_asof, kv_lru, kv_partition_ids, kv_partition_export, partition_digest, kv_backup_read, kv_compact, wal_crc_filter)}
SQL = {
    "kv_replay": f"WITH {_CHANGES} SELECT pid, col, key, seq, version, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at FROM state",
    "kv_put_fold": f"WITH {_A} SELECT pid, col, key, seq, op FROM ak",
    "kv_clear_fold": f"WITH {_A} SELECT pid, col, cleared AS seq FROM ax",
    "kv_get": f"WITH {_CHANGES} SELECT pid, col, key, val, version FROM live WHERE (col, key) = (SELECT (col, key) FROM kv_log WHERE op = 'put' AND key IS NOT NULL AND seq IS NOT NULL ORDER BY seq DESC, col DESC, key DESC LIMIT 1)",
    "kv_delete": f"WITH {_CHANGES} SELECT n.pid, n.col, n.key, live.seq IS NOT NULL AS deleted FROM {_named_sql('del', 'expire')} n LEFT JOIN live USING (pid, col, key)",
    "kv_clear": f"WITH {_CHANGES} SELECT pid, col, key, seq FROM state WHERE NOT starts_with(col, 's')",
    "kv_lru_reads": f"WITH {_CHANGES}, r AS (SELECT pid, col, key, max(seq) AS r FROM kv_log WHERE op = 'touch' AND key IS NOT NULL AND seq IS NOT NULL GROUP BY ALL), u AS (SELECT pid, col, key, greatest(seq, coalesce(r, seq)) AS last_access FROM state LEFT JOIN r USING (pid, col, key)) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pid, col ORDER BY last_access DESC, key) <= 3",
    "kv_registry": "SELECT name, s.ttl AS default_ttl, s.pid AS max_entries FROM (SELECT CASE WHEN coalesce(col, '') = '' THEN 'default' ELSE col END AS name, min(struct_pack(seq := seq, ttl := ttl, pid := pid)) AS s FROM kv_log WHERE ttl IS NOT NULL AND seq IS NOT NULL GROUP BY 1)",
    "kv_partition_import": f"WITH {_CHANGES} SELECT pid, col, key, seq, CASE WHEN pid % 2 = 0 THEN version * 2 ELSE version END AS version FROM state",
    "kv_drop_collections": f"WITH {_CHANGES} SELECT pid, col, key, seq FROM state WHERE col NOT IN (SELECT col FROM kv_log WHERE op = 'PUT' AND col IS NOT NULL)",
    "wal_scan": "SELECT op, count(*) AS n, sum(seq)::BIGINT AS seqs FROM kv_log GROUP BY op",
    "wal_compact": f"WITH {_CHANGES} SELECT pid, col, key, seq, val FROM state",
    "kv_get_many": f"WITH {_CHANGES} SELECT pid, col, key, val FROM live SEMI JOIN {_named_sql('touch')} USING (pid, col, key)",
    "kv_exists": f"WITH {_CHANGES} SELECT n.pid, n.col, n.key, live.seq IS NOT NULL AS found FROM {_named_sql('touch', 'expire')} n LEFT JOIN live USING (pid, col, key)",
    "kv_put_many": f"WITH {_CHANGES}, n AS (SELECT pid, col, key, max(val) AS val FROM kv_log WHERE key IS NOT NULL AND op = 'PUT' GROUP BY ALL) SELECT pid, col, key, CASE WHEN n.pid IS NOT NULL THEN n.val ELSE state.val END AS val, coalesce(version, 0) + (n.pid IS NOT NULL)::INT AS version FROM state FULL JOIN n USING (pid, col, key)",
    "kv_delete_many": f"WITH {_CHANGES} SELECT pid, col, key, seq FROM state ANTI JOIN {_named_sql('del', 'expire')} USING (pid, col, key)",
    "kv_keys": f"WITH {_CHANGES} SELECT pid, col, key FROM live",
    "kv_size": f"WITH {_CHANGES} SELECT col, count(*) AS n FROM live GROUP BY col",
    "kv_collections": f"WITH {_CHANGES}, e AS (SELECT pid, col, count(*) AS changes FROM kv_log GROUP BY ALL) SELECT pid, col, changes, EXISTS (SELECT 1 FROM state s WHERE s.pid = e.pid AND s.col = e.col) AS held FROM e",
    "kv_ttl_asof": f"WITH {_CHANGES} SELECT pid, col, key, floor((epoch_us(expires_at) - epoch_us(TIMESTAMPTZ '2025-07-01 00:00:00+00')) / 1000000)::BIGINT AS left_s FROM live",
    "kv_lru": f"WITH {_CHANGES} SELECT pid, col, key, seq FROM state QUALIFY row_number() OVER (PARTITION BY pid, col ORDER BY seq DESC, key) <= 3",
    "kv_partition_ids": "SELECT DISTINCT key, (('0x' || substr(md5(key), 1, 8))::BIGINT % 271)::INTEGER AS partition FROM kv_log WHERE key IS NOT NULL",
    "kv_partition_export": f"WITH {_CHANGES} SELECT pid, col, key, val, ttl, version FROM state",
    "partition_digest": f"WITH {_A}, {_B}, p AS ({_DIGEST.format('a')}), q AS ({_DIGEST.format('b')}) SELECT pid, coalesce(p.n, 0) AS entries, coalesce(q.n, 0) AS backup_entries FROM p FULL JOIN q USING (pid) WHERE p.d IS DISTINCT FROM q.d",
    "kv_backup_read": f"WITH {_A}, {_L} SELECT pid, col, key, coalesce(l.seq, a.seq) AS seq FROM l FULL JOIN a USING (pid, col, key)",
    "kv_compact": f"WITH {_CHANGES} SELECT seq, 'put' AS op, pid, col, key, val, ttl FROM state",
    "wal_crc_filter": "SELECT op, count(*) AS n FROM kv_log WHERE op IS NOT NULL GROUP BY op",
}
