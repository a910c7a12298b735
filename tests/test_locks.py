import datetime as dt
import random

import pytest

from shardloom.errors import LockAcquireTimeout
from shardloom.operators import locks

T0 = dt.datetime(2025, 1, 1)


def sequential(events, hold):
    """One counter and a dict, in order of seq."""
    token, held, out = 0, {}, {}
    for seq, key, op, owner, ts in sorted(events):
        h = held.get(key)
        if h and not ts < h[1] + dt.timedelta(seconds=hold):
            h = None
            held.pop(key)
        if op == "acquire":
            if h is None:
                token += 1
                held[key] = (owner, ts, token)
                out[seq] = ("granted", owner, token)
            elif h[0] == owner:
                held[key] = (owner, ts, h[2])
                out[seq] = ("refreshed", owner, h[2])
            else:
                out[seq] = ("denied", h[0], h[2])
        elif op == "release":
            if h is None:
                out[seq] = ("free", None, None)
            elif h[0] == owner:
                held.pop(key)
                out[seq] = ("released", None, None)
            else:
                out[seq] = ("mismatch", h[0], h[2])
        else:
            held.pop(key, None)
            out[seq] = ("forced" if h else "none", None, None)
    return out


def test_timeline(spark):
    rng = random.Random(4)
    events = [(i, rng.choice("ab"), rng.choice(["acquire", "acquire", "release", "force"]), rng.choice("xyz"), T0 + dt.timedelta(seconds=i * 7)) for i in range(400)]
    df = spark.createDataFrame(events + events[:50] + [(None, "a", "acquire", "x", T0), (900, None, "acquire", "x", T0)], "seq long, key string, op string, owner string, ts timestamp")
    got = {r.seq: (r.outcome, r.holder, r.token) for r in locks.timeline(df, 20.0).collect()}
    assert got == sequential(events, 20.0)
    assert locks.timeline(df.limit(0), 20.0).count() == 0


def test_handle():
    free, taken = [True], []

    def attempt(owner):
        return 1 if free[0] else None

    with locks.acquire(attempt, lambda o: taken.append(o) or True) as h:
        assert h.token == 1
    assert taken == [h.owner] and h.release()
    free[0] = False
    with pytest.raises(LockAcquireTimeout):
        locks.acquire(attempt, lambda o: True, timeout_s=0.05, poll_s=0.01)


def test_hold_times_and_tokens(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "k", "acquire", "x", at(0), 5.0, None), (2, "k", "acquire", "y", at(6), None, None), (3, "k", "release", "y", at(7), None, 1), (4, "k", "acquire", "y", at(8), 100.0, None), (5, "k", "acquire", "x", at(60), None, None), (6, "k", "release", "y", at(61), None, 2), (7, "k", "release", "y", at(62), None, None)]
    df = spark.createDataFrame(rows, "seq long, key string, op string, owner string, ts timestamp, hold_s double, grant long")
    done = locks.timeline(df, 20.0)
    got = {r.seq: (r.outcome, r.holder, r.token) for r in done.collect()}
    assert got == {1: ("granted", "x", 1), 2: ("granted", "y", 2), 3: ("mismatch", "y", 2), 4: ("refreshed", "y", 2), 5: ("denied", "y", 2), 6: ("released", None, None), 7: ("free", None, None)}
    assert [tuple(r) for r in locks.counts(done).collect()] == [("k", 4, 2, 1, 1)]
