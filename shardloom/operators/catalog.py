"""The catalogue of indices and their shards. Functions take and return DataFrames; the store commits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.errors import AlreadyExists, InvalidArgument, NotFound
from shardloom.functions.placement import shard_name


def valid(index: DataFrame) -> DataFrame:
    """Rows that may be created: a name, shards above 0, and for both chunk sizes 0 <= overlap < size."""
    fits = lambda size, lap: (F.col(size) > 0) & (F.col(lap) >= 0) & (F.col(lap) < F.col(size))
    ok = (F.coalesce("index_name", F.lit("")) != "") & (F.col("number_of_shards") > 0)
    return index.where(ok & fits("max_parent_chunk_size", "parent_chunk_overlap_size") & fits("max_child_chunk_size", "child_chunk_overlap_size"))


def shards_of(indices: DataFrame) -> DataFrame:
    """shard_name, index_name, shard_number of each index; none for one without shards."""
    numbers = F.explode(F.sequence(F.lit(0), F.col("number_of_shards") - 1)).alias("shard_number")
    return indices.where("number_of_shards > 0").select("index_name", numbers).select(shard_name(F.col("index_name"), F.col("shard_number")).alias("shard_name"), "index_name", "shard_number")


def create(indices: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """indices with the new rows. Existing names and invalid rows raise; a name that new holds twice does too."""
    if not new.join(indices.select("index_name"), "index_name", "left_semi").isEmpty():
        raise AlreadyExists("an index of that name exists")
    if valid(new).count() != new.select("index_name").distinct().count() or new.count() != valid(new).count():
        raise InvalidArgument("sizes, overlaps or shards of a new index are not valid, or its name is given twice")
    stamped = new.withColumns({"creation_timestamp": now, "modification_timestamp": now})
    return indices.unionByName(stamped.select(indices.columns))


def update(indices: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """indices with new descriptions (index_name, description); a null description keeps the old one, the time is set.

    Unknown names are ignored; of several changes to an index the greatest description counts.
    """
    new = changes.groupBy("index_name").agg(F.max("description").alias("_new")).withColumn("_hit", F.lit(True))
    both = indices.join(new, "index_name", "left")
    return both.select(*[F.coalesce("_new", "description").alias(c) if c == "description" else F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "modification_timestamp" else F.col(c) for c in indices.columns])


def delete(tables: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the named indices: catalogue, shards, documents, chunks."""
    gone = names.select("index_name").distinct()
    return {name: df.join(gone, "index_name", "left_anti") for name, df in tables.items()}


def get(indices: DataFrame, name: str) -> DataFrame:
    """The row of the index. Raises NotFound."""
    row = indices.where(F.col("index_name") == name)
    if row.isEmpty():
        raise NotFound(f"no index {name}")
    return row


def exist(indices: DataFrame, names: DataFrame) -> DataFrame:
    """index_name, found of the distinct names that aren't null."""
    known = indices.select("index_name", F.lit(True).alias("found")).distinct()
    return names.select("index_name").where("index_name IS NOT NULL").distinct().join(known, "index_name", "left").withColumn("found", F.coalesce("found", F.lit(False)))
