import random

import pytest
from pyspark.sql import Row

from shardloom.operators.cache import replay
from shardloom.operators.changelog import fold_changes, live_entries

SCHEMA = "pid int, col string, key string, seq long, op string, val string, ttl double, ts timestamp"


def random_log(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = rng.choices(["put", "delete", "clear", "PUT", None, "touch"], [12, 4, 1, 1, 1, 1])[0]
        key = None if op == "clear" or rng.random() < 0.03 else rng.choice("abcdef")
        rows.append((rng.choice([1, 2, None]), rng.choice(["x", "y"]), key, None if rng.random() < 0.03 else seq, op, rng.choice(["1", "", None]), rng.choice([None, 0.0, 5.0]), None))
    return rows


def sequential(rows):
    state, version = {}, {}
    for pid, col, key, seq, op, val, *_ in sorted({r[3]: r for r in rows if r[3] is not None}.values(), key=lambda r: r[3]):
        if op == "clear":
            for k in [k for k in state if k[:2] == (pid, col)]:
                del state[k], version[k]
        elif key is not None and op == "put":
            state[pid, col, key] = (seq, val)
            version[pid, col, key] = version.get((pid, col, key), 0) + 1
        elif key is not None and op == "delete":
            state.pop((pid, col, key), None)
            version.pop((pid, col, key), None)
    return state, version


def as_dict(df):
    return {(r.pid, r.col, r.key): (r.seq, r.val) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_sequential(spark, seed):
    rows = random_log(seed)
    want, version = sequential(rows)
    rng = random.Random(seed)
    shuffled = rows + rng.sample(rows, 100)
    rng.shuffle(shuffled)
    log = spark.createDataFrame(shuffled, SCHEMA)
    assert as_dict(live_entries(fold_changes(log))) == want
    got = replay(log).collect()
    assert {(r.pid, r.col, r.key): r.version for r in got} == version
    # batches in any order, some twice, on top of a base
    parts = [spark.createDataFrame(shuffled[i::3], SCHEMA) for i in range(3)]
    state = fold_changes(parts[2])
    for p in (parts[0], parts[2], parts[1], parts[0]):
        state = fold_changes(p, state)
    assert as_dict(live_entries(state)) == want


def test_tombstone_against_late_put(spark):
    row = lambda seq, op, key="k": (1, "c", key, seq, op, "v", None, None)
    state = fold_changes(spark.createDataFrame([row(5, "delete")], SCHEMA))
    assert state.count() == 1 and as_dict(live_entries(fold_changes(spark.createDataFrame([row(4, "put")], SCHEMA), state))) == {}
    cleared = fold_changes(spark.createDataFrame([row(5, "clear", None)], SCHEMA))
    assert as_dict(live_entries(fold_changes(spark.createDataFrame([row(4, "put"), row(6, "put", "l")], SCHEMA), cleared))) == {(1, "c", "l"): (6, "v")}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert live_entries(fold_changes(empty)).count() == 0 and replay(empty).count() == 0
    more = spark.createDataFrame([Row(pid=1, col="c", key="k", seq=1, op="put", val="v", ttl=None, ts=None, last="x", cleared=9, payload="p", _cleared_at=3)], SCHEMA + ", last string, cleared int, payload string, _cleared_at long")
    assert as_dict(live_entries(fold_changes(more))) == {(1, "c", "k"): (1, "v")}


def test_very_long_value(spark):
    log = spark.createDataFrame([(1, "c", "k", 1, "put", "x" * 1_000_000, None, None)], SCHEMA)
    assert len(live_entries(fold_changes(log)).first().val) == 1_000_000
