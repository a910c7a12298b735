"""Metrics of a plan, counted while it runs and without another pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def metered(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and the observation that holds its number of rows and the given aggregates once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]), seen


def reported(spark: SparkSession, *observations: Observation) -> DataFrame:
    """source, metric, value of observations whose actions have run; values that aren't numbers are left out."""
    rows = [(o._name, k, float(v)) for o in observations for k, v in o.get.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "source string, metric string, value double")
