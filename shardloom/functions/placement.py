"""Where documents and cache keys live. These formulas are part of the data format and equal in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE_PARTITIONS = 271


def shard_of(index: Column, document: Column, shards: Column) -> Column:
    """SHA-256 of `index/document` as a number, modulo the number of shards. Null where shards is null or not above 0."""
    digest = F.sha2(F.concat_ws("/", index, document), 256)
    pieces = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)])
    folded = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: (a * F.lit(4294967296) + x) % shards)
    return F.when((shards > 0) & index.isNotNull() & document.isNotNull(), folded).cast("int")


def shard_name(index: Column, number: Column) -> Column:
    return F.format_string("%s_%06d", index, number)


def partition_of(key: Column, partitions: int = CACHE_PARTITIONS) -> Column:
    """The first 32 bits of the key's MD5, modulo the number of partitions."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % partitions).cast("int")
