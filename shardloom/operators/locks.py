"""Locks with fencing tokens: an event-ordered state machine.

Events of a key must be seen in order, so they are sorted within a partition and streamed through the machine batch by
batch: a key of any number of events takes bounded memory. The token is one counter over all keys, numbered afterwards.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.errors import LockAcquireTimeout
from shardloom.operators.numbering import numbered
from shardloom.sources.scratch import materialize

_OUT = "seq long, key string, op string, owner string, outcome string, holder string, grant long"


def step(state: tuple | None, op: str, owner: str, at: float, hold: float, grant: int | None = None) -> tuple[tuple | None, str, str | None]:
    """One event: (owner, acquired_at, grant seq, hold) or None before and after, the outcome and the holder then.

    acquire: granted if free or expired, refreshed for the same owner (same token, the new request's hold time), else
    denied. release: free if there is nothing to release or it expired, released by the owner, mismatch for others and
    for a grant other than the one held. force: forced or none. A lock expires the hold time of its request after it.
    """
    held = state if state and at < state[1] + state[3] else None
    if op == "acquire":
        if held is None:
            return (owner, at, None, hold), "granted", owner
        if held[0] == owner:
            return (owner, at, held[2], hold), "refreshed", owner
        return held, "denied", held[0]
    if op == "release":
        if held is None:
            return None, "free", None
        mine = held[0] == owner and (grant is None or grant == held[2])
        return (None, "released", None) if mine else (held, "mismatch", held[0])
    if op == "force":
        return None, "forced" if held else "none", None
    return held, "unknown", held[0] if held else None


def _machine():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            out = []
            for seq, k, op, owner, at, hold, grant in zip(*(rows[c] for c in ("seq", "key", "op", "owner", "at", "hold", "grant"))):
                if k != key:
                    key, state = k, None
                state, outcome, holder = step(state, op, owner, at, hold, None if pd.isna(grant) else int(grant))
                if outcome == "granted":
                    state = (*state[:2], seq, hold)
                out.append((seq, k, op, owner, outcome, holder, state[2] if state else None))
            made = pd.DataFrame(out, columns=["seq", "key", "op", "owner", "outcome", "holder", "grant"])
            made["grant"] = made["grant"].astype("Int64")
            yield made

    return run


def timeline(events: DataFrame, hold_s: float) -> DataFrame:
    """seq, key, op, owner, outcome, holder, token: what each event did. events: seq, key, op, owner, ts.

    Two columns may be there besides: hold_s, the hold time that an acquire asks for (null: the default), and grant, the
    seq of the grant that a release names (null: any of its owner's), so that a holder whose lock has passed to another
    grant can't release it. Rows without seq, key or ts are left out; rows that repeat a seq count once. token is that of the lock held after
    the event, from 1, in order of the grants over all keys; null when it is free.
    """
    hold = (F.coalesce("hold_s", F.lit(hold_s)) if "hold_s" in events.columns else F.lit(hold_s)).cast("double").alias("hold")
    grant = (F.col("grant") if "grant" in events.columns else F.lit(None)).cast("long").alias("grant")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    usable = events.where("seq IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL").select("seq", "key", "op", "owner", at, hold, grant).dropDuplicates(["seq"])
    ordered = usable.repartition("key").sortWithinPartitions("key", "seq")
    done = materialize(ordered.mapInPandas(_machine(), _OUT), "locks")
    tokens = numbered(done.where("outcome = 'granted'").select(F.col("seq").alias("grant")), (), ("grant",), "n")
    return done.join(tokens, "grant", "left").select("seq", "key", "op", "owner", "outcome", "holder", (F.col("n") + 1).alias("token"))


def held_at(done: DataFrame, events: DataFrame, now, hold_s: float) -> DataFrame:
    """key, holder, token of the locks held at `now`, from a timeline and its events."""
    hold = (F.coalesce("hold_s", F.lit(hold_s)) if "hold_s" in events.columns else F.lit(hold_s)).cast("double").alias("hold")
    when = events.select("seq", F.col("ts").cast("timestamp").alias("ts"), hold).dropDuplicates(["seq"])
    seen = done.join(when, "seq").where(F.col("ts") <= now)
    last = seen.groupBy("key").agg(F.max(F.struct("seq", "holder", "token")).alias("s"), F.max(F.when(F.col("outcome").isin("granted", "refreshed"), F.struct("seq", "ts", "hold"))).alias("a"))
    fresh = F.unix_micros("a.ts") + (F.col("a.hold") * 1_000_000).cast("long") > F.unix_micros(now)
    return last.where(F.col("s.holder").isNotNull() & fresh).select("key", "s.holder", "s.token")


def counts(done: DataFrame) -> DataFrame:
    """key, attempts, grants, refreshes, denials of each lock over its timeline."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return done.groupBy("key").agg(F.count_if(F.col("op") == "acquire").alias("attempts"), n("granted").alias("grants"), n("refreshed").alias("refreshes"), n("denied").alias("denials"))


class LockHandle:
    """A lock in a `with` block; released once, on leaving it."""

    def __init__(self, release: Callable[[str], bool], owner: str, token: int) -> None:
        self._release, self.owner, self.token, self.released = release, owner, token, False

    def release(self) -> bool:
        if self.released:
            return True
        self.released = True
        return self._release(self.owner)

    def __enter__(self) -> LockHandle:
        return self

    def __exit__(self, *exc) -> None:
        self.release()


def acquire(try_acquire: Callable[[str], int | None], release: Callable[[str], bool], timeout_s: float = 30.0, poll_s: float = 0.2) -> LockHandle:
    """Tries until the deadline with a new owner id; try_acquire returns the token or None."""
    owner, deadline = uuid.uuid4().hex, time.monotonic() + timeout_s
    while (token := try_acquire(owner)) is None:
        if time.monotonic() >= deadline:
            raise LockAcquireTimeout(f"not free within {timeout_s} s")
        time.sleep(poll_s)
    return LockHandle(release, owner, token)
