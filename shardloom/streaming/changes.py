"""Streaming twins: the change fold, entries with time to live, bounded collections, bursts, heartbeats, and locks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.cache import bound
from shardloom.operators.changelog import fold_changes, valid_changes
from shardloom.operators.locks import step
from shardloom.sources.store import Store

#: Micro-batches after which the state's deltas are folded into one.
COMPACT_EVERY = 16


def _until_done(log: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(log: DataFrame, store: Store, checkpoint: str, table: str = "state", payload: tuple[str, ...] = ("val", "ttl", "ts"), compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Fold a stream of changes into a table of the store, micro-batch by micro-batch, until all that is there is read.

    A batch is folded by itself and appended, so that its cost is its own size and not that of the state; after
    `compact_every` batches the deltas are folded into one. folded() reads the state. Because the fold is idempotent
    and commutative, a batch that is delivered again after a failure changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        version = store.commit({table: fold_changes(batch, payload=payload)}, append=True)
        if version % compact_every == 0:
            store.commit({table: folded(store, table, payload)})

    return _until_done(log, merge, checkpoint)


def folded(store: Store, table: str = "state", payload: tuple[str, ...] = ("val", "ttl", "ts")) -> DataFrame:
    """The state that fold_stream keeps, tombstones and clear markers included."""
    deltas = store.read(table)
    return fold_changes(deltas, payload=payload)


def latest_by_key(log: DataFrame) -> DataFrame:
    """The fold as a streaming aggregation, for update mode: pid, col, key, last (seq, op, val)."""
    rows = log.where("seq IS NOT NULL AND op IN ('put', 'delete') AND key IS NOT NULL")
    return rows.groupBy("pid", "col", "key").agg(F.max(F.struct("seq", "op", "val")).alias("last"))


def bounded_stream(log: DataFrame, store: Store, checkpoint: str, most: int, table: str = "bounded") -> StreamingQuery:
    """Keep, of each partition and collection, the `most` keys that were put last, in a table pid, col, key, seq.

    A micro-batch sends on the greatest seq of its keys, is merged with what is held, and bounded again: the state has
    `most` rows a collection. Puts may come in any order and again. Deletes and clears are not looked at.
    """

    def merge(batch: DataFrame, _: int) -> None:
        puts = valid_changes(batch).where("op = 'put'").select("pid", "col", "key", "seq")
        rows = store.read(table).unionByName(puts) if store.version() else puts
        best = rows.groupBy("pid", "col", "key").agg(F.max("seq").alias("seq"))
        store.commit({table: bound(best, most, ("seq",))})

    return _until_done(log, merge, checkpoint)


def expirations(puts: DataFrame, late: str = "1 minute") -> DataFrame:
    """key, seq, expired_at: entries that came to the end of their time to live before they were put again.

    puts: key string, seq long, ts timestamp, ttl double (seconds; null or not above 0: never), in order of ts for each
    key. An entry is expired from ts + ttl on, in milliseconds: told when a later put of the key arrives, or by a timer
    once the watermark has passed. Expired state is removed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            seq, ends = state.get
            out.append((key[0], seq, ends))
            state.remove()
        else:
            seq, ends = state.get if state.exists else (0, -1)
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for s, t, ttl in zip(rows["seq"].tolist(), (rows["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), rows["ttl"].tolist()):
                if ends >= 0 and ends <= t:
                    out.append((key[0], seq, ends))
                seq, ends = s, t + int(ttl * 1000) if ttl and ttl > 0 else -1
            if ends >= 0:
                state.update((seq, ends))
                state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"key": [o[0] for o in out], "seq": [o[1] for o in out], "expired_at": pd.to_datetime([o[2] for o in out], unit="ms")})

    rows = puts.where("key IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select("key", "seq", "ts", "ttl").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, seq long, expired_at timestamp", "seq long, ends long", "append", "EventTimeTimeout")


def bursts(changes: DataFrame, by: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of membership changes (ts timestamp) of each cluster `by`, closed by the watermark."""
    rows = changes.withWatermark("ts", late)
    return rows.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select(by, "w.start", "w.end", "changes")


def heartbeats(beats: DataFrame, timeout_s: int = 15, late: str = "1 minute") -> DataFrame:
    """address, event ('dead'), at: nodes (address, ts) that stayed silent for longer than the timeout, by event time."""

    def silent(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"address": [key[0]], "event": ["dead"], "at": [pd.Timestamp(last + timeout_s * 1000, unit="ms")]})
            return
        last = max([state.get[0]] if state.exists else [0])
        for rows in batches:
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark("ts", late)
    return rows.groupBy("address").applyInPandasWithState(silent, "address string, event string, at timestamp", "last long", "append", "EventTimeTimeout")


def lock_stream(events: DataFrame, hold_s: float, late: str | None = None) -> DataFrame:
    """seq, key, outcome, holder of lock events (seq, key, op, owner, ts) that arrive in order of seq.

    With `late`, the watermark's delay, a lock whose hold time has passed is also told by a timer, as a row without seq
    whose outcome is `expired`, and its state is removed; without it a lock expires when its next event is seen.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        held = (held[0], held[1], held[2], hold_s) if held and held[0] else None
        out = []
        if late and state.hasTimedOut:
            out.append((None, key[0], "expired", held[0] if held else None))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for seq, op, owner, ts in zip(rows["seq"], rows["op"], rows["owner"], rows["ts"]):
                held, outcome, holder = step(held, op, owner, ts.timestamp(), hold_s)
                if outcome == "granted":
                    held = (*held[:2], seq, hold_s)
                out.append((seq, key[0], outcome, holder))
            state.update((held[0], held[1], int(held[2] or 0)) if held else ("", 0.0, 0))
            if late and held:
                state.setTimeoutTimestamp(max(int((held[1] + hold_s) * 1000), state.getCurrentWatermarkMs() + 1))
            elif late:
                state.remove()
        made = pd.DataFrame(out, columns=["seq", "key", "outcome", "holder"])
        made["seq"] = made["seq"].astype("Int64")
        yield made

    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("key").applyInPandasWithState(run, "seq long, key string, outcome string, holder string", "owner string, at double, grant long", "append", "EventTimeTimeout" if late else "NoTimeout")


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A change log in a folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
