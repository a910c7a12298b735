"""Applying a change feed: a commutative fold over puts, deletes and clears.

The state of a key is the greatest struct (seq, op, payload) seen for it, so the fold is associative, commutative and
idempotent: batches may be applied in any order, repeatedly, and on top of base rows that an earlier fold left.
Deletes stay in the state as tombstones and a clear stays as a marker of its collection, so that an older change
that arrives late cannot revive an entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("put", "delete", "clear")


def valid_changes(changes: DataFrame, scope: Sequence[str] = ("pid", "col"), key: str = "key", seq: str = "seq", op: str = "op") -> DataFrame:
    """Rows that are changes: a known op compared exactly, a seq, and a key unless the op is clear.

    Rows with null seq, another or null op, or a put or delete without key are no changes. Null scope columns are
    values of their own: null equals null.
    """
    return changes.where(F.col(seq).isNotNull() & F.col(op).isin(*OPS) & ((F.col(op) == "clear") | F.col(key).isNotNull()))


def _latest(seq: str, op: str, payload: Sequence[str]) -> Column:
    # Ties of seq are one change received again; should they differ, the greater op and payload win, in any order.
    return F.max(F.struct(F.col(seq).alias("seq"), F.col(op).alias("op"), F.struct(*[F.col(c) for c in payload]).alias("payload"))).alias("last")


def fold_changes(
    changes: DataFrame,
    base: DataFrame | None = None,
    scope: Sequence[str] = ("pid", "col"),
    key: str = "key",
    payload: Sequence[str] = ("val", "ttl", "ts"),
    seq: str = "seq",
    op: str = "op",
) -> DataFrame:
    """State after all changes, tombstones and clear markers included.

    Columns: scope, key, seq, op, payload columns. A row with op `clear` and a null key is the marker of its scope.
    `base` is a state that this function returned, or any rows of the same columns with op `put`.
    Extra columns of either input are ignored; payload columns must be orderable. Empty inputs give an empty state.
    Map-side partial maxima keep a hot key from crowding one task: each map task sends one row a key.
    """
    columns = [*scope, key, seq, op, *payload]
    rows = valid_changes(changes, scope, key, seq, op).select(*columns)
    if base is not None:
        rows = rows.unionByName(base.select(*columns))
    rows = rows.withColumn(key, F.when(F.col(op) != "clear", F.col(key)))
    # The scope's own name may clash with seq/op inside the struct, therefore the struct is built first.
    folded = rows.groupBy(*scope, key).agg(_latest(seq, op, payload))
    return folded.select(*scope, key, F.col("last.seq").alias(seq), F.col("last.op").alias(op), *[F.col(f"last.payload.{c}").alias(c) for c in payload])


def live_entries(state: DataFrame, scope: Sequence[str] = ("pid", "col"), key: str = "key", seq: str = "seq", op: str = "op") -> DataFrame:
    """Entries that the state holds: the last change is a put, and no clear of the scope comes after it.

    A clear with the same seq as a put is the same number of change; the put then does not survive.
    The join is on the scope, null-safe. Its clear side has one row a scope; AQE broadcasts it when it is measured
    to be small and otherwise splits hot scopes of the entry side.
    """
    entries = state.where((F.col(op) == "put") & F.col(key).isNotNull())
    cleared = state.where((F.col(op) == "clear") & F.col(key).isNull()).select(*[F.col(c).alias(f"_c_{c}") for c in scope], F.col(seq).alias("_cleared_at"))
    on = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in scope]
    return entries.join(cleared, on, "left").where(F.col("_cleared_at").isNull() | (F.col(seq) > F.col("_cleared_at"))).select(*state.columns)
