"""Consecutive numbers and running sums without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.sources.scratch import materialize


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of `sums`, the sum of its weight over the rows before, within each key in the given order.

    Rows are range-partitioned by key and order, so that a hot key spreads over many tasks; each part is summed by
    itself, and the sums of the parts before it (one row a part and key) give what to add. Rows that tie in order come
    in no particular order; null keys are a key of their own. Pass narrow rows: they are written twice.
    """
    part, names = "_part", list(sums)
    ranged = materialize(df.withColumns({f"_w_{n}": w.cast("long") for n, w in sums.items()}), "weights")  # else sampling computes df again
    ranged = ranged.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "ranged")  # ranges are sampled; they must not change between the two uses
    sizes = ranged.groupBy(*keys, part).agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names]
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), *earlier)
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_w_{n}").over(own), F.lit(0)) for n in names})
    on = F.col(part) == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(offsets, on).select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in names])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with `name`, from 0 within each key in the given order; rows that tie get different numbers."""
    return running_sums(df, keys, order, {name: F.lit(1)})
