"""The key/value cache as tables: state from the log, reads, bulk operations, expiry, bounds, partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument, QuorumLost
from shardloom.operators.changelog import valid_changes

ENTRY = ("pid", "col", "key")


def expires_at(ts: Column, ttl: Column, default_ttl: float | None = None) -> Column:
    """ts + ttl; null, that is never, for a ttl of 0. A null ttl takes the collection's default; without one, never."""
    ttl = F.coalesce(ttl, F.lit(default_ttl).cast("double"))
    return F.when(ttl > 0, F.timestamp_micros(F.unix_micros(ts) + F.round(ttl * 1e6).cast("long")))


def alive(at: Column, expires: Column) -> Column:
    """An entry is expired from the moment of its expiry on."""
    return expires.isNull() | (at < expires)


def replay(log: DataFrame) -> DataFrame:
    """Entries with version and times, from all changes in order of seq.

    Columns: pid, col, key, seq, val, ttl, version, created_at, updated_at, expires_at. A put after a delete or clear
    starts at version 1; expiry doesn't reset versions. A change that was received again counts once, the greatest of
    its copies. Unknown operations are skipped. Aggregations only: a hot key is combined before the shuffle.
    """
    payload = F.struct("op", "val", "ttl", "ts")
    once = valid_changes(log).withColumn("key", F.when(F.col("op") != "clear", F.col("key"))).groupBy(*ENTRY, "seq").agg(F.max(payload).alias("c")).select(*ENTRY, "seq", "c.*")
    clears = once.where("op = 'clear'").groupBy("pid", "col").agg(F.max("seq").alias("cleared"))
    entries = once.where("op <> 'clear'")
    resets = entries.where("op = 'delete'").groupBy(*ENTRY).agg(F.max("seq").alias("deleted"))
    same = lambda keys: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    under = lambda df: df.withColumnsRenamed({k: f"_{k}" for k in ENTRY})
    after = entries.where("op = 'put'").join(under(resets), same(ENTRY), "left").drop(*[f"_{k}" for k in ENTRY])
    after = after.join(under(clears), same(("pid", "col")), "left").drop("_pid", "_col")
    after = after.where(F.col("seq") > F.greatest(F.coalesce("deleted", F.lit(-(2**63))), F.coalesce("cleared", F.lit(-(2**63)))))
    state = after.groupBy(*ENTRY).agg(F.max(F.struct("seq", "val", "ttl", "ts")).alias("last"), F.count(F.lit(1)).alias("version"), F.min(F.struct("seq", "ts")).alias("first"))
    state = state.select(*ENTRY, "last.seq", "last.val", "last.ttl", "version", F.col("first.ts").alias("created_at"), F.col("last.ts").alias("updated_at"))
    return state.withColumn("expires_at", expires_at(F.col("updated_at"), F.col("ttl")))


def get(state: DataFrame, collection: str, key: str, now: Column) -> DataFrame:
    """The entry of a key, if it is alive. The predicate reaches the scan."""
    return state.where((F.col("col") == collection) & (F.col("key") == key) & alive(now, F.col("expires_at")))


def get_many(state: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Entries of the keys (pid, col, key) that are alive; repeated keys count once."""
    return state.where(alive(now, F.col("expires_at"))).join(keys.select(*ENTRY).distinct(), list(ENTRY), "left_semi")


def exists_many(state: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys with `found`."""
    live = state.where(alive(now, F.col("expires_at"))).select(*ENTRY, F.lit(True).alias("found"))
    return keys.select(*ENTRY).distinct().join(live, list(ENTRY), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def touched(state: DataFrame, reads: DataFrame) -> DataFrame:
    """state with last_access, the greatest seq of a put or a read of the entry (reads: pid, col, key, seq).

    A read before the entry's last put, or of a key that isn't there, changes nothing.
    """
    last = reads.where("seq IS NOT NULL").groupBy(*ENTRY).agg(F.max("seq").alias("_read"))
    return state.join(last, list(ENTRY), "left").withColumn("last_access", F.greatest("seq", "_read")).drop("_read")


def delete_one(state: DataFrame, keys: DataFrame, now: Column, visible: int | None = None, expected: int = 1) -> tuple[DataFrame, DataFrame]:
    """(state without the keys, keys with `deleted`: whether the entry was there and alive)."""
    check_quorum(visible, expected)
    return delete_many(state, keys), exists_many(state, keys, now).withColumnRenamed("found", "deleted")


def clear(state: DataFrame, collections: DataFrame, visible: int | None = None, expected: int = 1) -> DataFrame:
    """state without the entries of the collections (pid, col). Raises QuorumLost as put_many does."""
    check_quorum(visible, expected)
    return state.join(collections.select("pid", "col").distinct(), ["pid", "col"], "left_anti")


#: The collection of calls that name none.
DEFAULT_COLLECTION = "default"


def in_collection(requests: DataFrame, col: str = "col") -> DataFrame:
    """requests with the default collection where they name none; an empty name is none."""
    return requests.withColumn(col, F.when(F.coalesce(col, F.lit("")) == "", DEFAULT_COLLECTION).otherwise(F.col(col)))


def put_many(state: DataFrame, batch: DataFrame, now: Column, visible: int | None = None, expected: int = 1) -> DataFrame:
    """state after the batch (pid, col, key, val, ttl): created_at stays, version grows, expiry is computed anew.

    A key that the batch holds more than once takes its greatest (val, ttl). Raises QuorumLost before anything is written
    when fewer nodes are visible than the quorum of those expected.
    """
    check_quorum(visible, expected)
    new = batch.groupBy(*ENTRY).agg(F.max(F.struct("val", "ttl")).alias("n"))
    held = state.select(*ENTRY, F.struct("val", "ttl", "version", "created_at", "updated_at", "expires_at").alias("h"))
    both = held.join(new, list(ENTRY), "full_outer")
    put = F.col("n").isNotNull()
    return both.select(
        *ENTRY, F.when(put, F.col("n.val")).otherwise(F.col("h.val")).alias("val"), F.when(put, F.col("n.ttl")).otherwise(F.col("h.ttl")).alias("ttl"),
        (F.coalesce("h.version", F.lit(0)) + put.cast("int")).alias("version"), F.coalesce("h.created_at", now).alias("created_at"),
        F.when(put, now).otherwise(F.col("h.updated_at")).alias("updated_at"), F.when(put, expires_at(now, F.col("n.ttl"))).otherwise(F.col("h.expires_at")).alias("expires_at"))


def delete_many(state: DataFrame, keys: DataFrame, visible: int | None = None, expected: int = 1) -> DataFrame:
    """state without the keys; entries that expired but weren't swept are removed too. Raises QuorumLost as put_many does."""
    check_quorum(visible, expected)
    return state.join(keys.select(*ENTRY).distinct(), list(ENTRY), "left_anti")


def bound(state: DataFrame, most: int, recency: Sequence[str] = ("updated_at", "seq"), within: Sequence[str] = ("pid", "col")) -> DataFrame:
    """The `most` entries of each partition and collection used last; expired ones count too, ties go to the smaller key."""
    if most <= 0:
        raise InvalidArgument("the bound must be above 0")
    w = Window.partitionBy(*within).orderBy(*[F.desc(c) for c in recency], "key")
    return state.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def quorum(expected: int, strict_majority: bool = False) -> int:
    """Nodes needed: half of those expected, rounded up; with strict_majority more than half."""
    return expected // 2 + 1 if strict_majority else (expected + 1) // 2


def check_quorum(visible: int | None, expected: int, strict_majority: bool = False) -> None:
    if visible is not None and expected > 1 and visible < quorum(expected, strict_majority):
        raise QuorumLost(f"{visible} of {expected} nodes are visible")


def digest(state: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by, entries, digest: an order-free digest of each partition, the sum of its rows' 32-bit hashes.

    A sum needs no sorted list of a partition's rows, so that partitions of any size are combined map-side.
    """
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return state.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.sum(h).alias("digest"))


def compact(log: DataFrame) -> DataFrame:
    """The log that rebuilds the same live state: one put an entry, with its seq, ts and ttl."""
    return replay(log).select("seq", F.col("updated_at").alias("ts"), F.lit("put").alias("op"), *ENTRY, "val", "ttl")


def checked(log: DataFrame, payload: str, crc: str) -> DataFrame:
    """Records whose checksum holds; damaged records, and those without payload or checksum, are skipped."""
    return log.where(F.crc32(F.col(payload).cast("binary")) == F.col(crc))


def registry(requests: DataFrame) -> DataFrame:
    """name, default_ttl, max_entries of each collection: the settings of the first request (seq) for it win.

    requests: seq, name, default_ttl, max_entries. Requests without name or seq are ignored.
    """
    first = F.min(F.struct("seq", "default_ttl", "max_entries")).alias("first")
    return requests.where("name IS NOT NULL AND seq IS NOT NULL").groupBy("name").agg(first).select("name", "first.default_ttl", "first.max_entries")


def drop_collections(state: DataFrame, names: DataFrame) -> DataFrame:
    """state without the collections (col), over all partitions."""
    return state.join(names.select("col").distinct(), "col", "left_anti")


def import_partitions(state: DataFrame, rows: DataFrame) -> DataFrame:
    """state with the partitions (pid) that rows hold replaced by rows; versions, times and expiry are kept as they are."""
    return state.join(rows.select("pid").distinct(), "pid", "left_anti").unionByName(rows.select(state.columns))
