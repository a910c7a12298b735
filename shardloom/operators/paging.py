"""Keyset pages: rows in key order from an inclusive offset, with the token of the next page."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument


@dataclass
class Page:
    rows: list[Row]
    next_offset: str | None
    completed: bool


def encode_token(*parts: object) -> str:
    """Parts as url-safe base64, joined by dots."""
    return ".".join(base64.urlsafe_b64encode(str(p).encode()).decode() for p in parts)


def decode_token(token: str, parts: int) -> list[str]:
    try:
        found = [base64.b64decode(p.encode(), altchars=b"-_", validate=True).decode() for p in token.split(".")]
    except ValueError as e:
        raise InvalidArgument(f"not a page token: {token}") from e
    if len(found) != parts:
        raise InvalidArgument(f"not a page token: {token}")
    return found


def keyset(df: DataFrame, key: str, offset: str | None, limit: int) -> DataFrame:
    """At most limit + 1 rows from offset on (inclusive); the last of limit + 1 is the next page's offset."""
    if limit <= 0:
        raise InvalidArgument("limit must be above 0")
    rows = df if not offset else df.where(F.col(key) >= offset)
    return rows.orderBy(key).limit(limit + 1)


def keyset_page(df: DataFrame, key: str, offset: str | None, limit: int) -> Page:
    """A page by one key. offset is the token of the page before, or none."""
    rows = keyset(df, key, decode_token(offset, 1)[0] if offset else None, limit).collect()  # limit + 1 rows
    more = len(rows) > limit
    return Page(rows[:limit], encode_token(rows[limit][key]) if more else None, not more)


def sharded(df: DataFrame, shard: str, key: str, offset: tuple[int, str] | None, limit: int) -> DataFrame:
    """limit + 1 rows in order of shard and key, from (shard, key) on; an empty key is the shard's beginning."""
    if limit <= 0:
        raise InvalidArgument("limit must be above 0")
    if offset:
        s, k = offset
        df = df.where((F.col(shard) > s) | ((F.col(shard) == s) & (F.col(key) >= k)))
    return df.orderBy(shard, key).limit(limit + 1)


def sharded_page(df: DataFrame, shard: str, key: str, shards: int, offset: str | None, limit: int) -> Page:
    """A page over shards. A token that is malformed or names a shard that doesn't exist is an invalid argument."""
    at = None
    if offset:
        s, k = decode_token(offset, 2)
        if not s.isdigit() or int(s) >= shards:
            raise InvalidArgument(f"not a page token: {offset}")
        at = (int(s), k)
    rows = sharded(df, shard, key, at, limit).collect()  # limit + 1 rows
    more = len(rows) > limit
    return Page(rows[:limit], encode_token(rows[limit][shard], rows[limit][key]) if more else None, not more)
