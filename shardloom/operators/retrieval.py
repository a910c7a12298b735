"""Exact vector retrieval: per-shard top k, global merge, threshold, best child a parent, content joined last."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.errors import InvalidArgument, NotFound


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two float arrays in double precision. Null if lengths differ or either is null."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x))


def score_exact(vectors: DataFrame, query: DataFrame, keep: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """keep, score of every comparable vector; query is one row with the column `q`, which is broadcast by nature.

    Vectors that are null, of another length, or give NaN are left out.
    """
    scored = vectors.crossJoin(F.broadcast(query)).select(*keep, squared_l2(F.col(embedding), F.col("q")).alias("score"))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score"))


def score_blocks(vectors: DataFrame, query: Sequence[float], keep: Sequence[str], k: int, shard: Sequence[str] = (), embedding: str = "embedding") -> DataFrame:
    """The fast path of score_exact: NumPy by Arrow batch, which passes on only the k best of a batch and shard.

    The result is a superset of each shard's k best; the caller's window cuts it exactly.
    """
    q = np.asarray(query, np.float64)
    schema = vectors.select(*keep).schema.add("score", "double")
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            fits = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), len(q)), False))
            batch = batch.filter(pa.array(fits))
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
            score = ((x - q) ** 2).sum(1)
            ok = ~np.isnan(score)
            if shard:
                _, group = np.unique(np.array(list(zip(*[batch.column(names.index(s)).to_pylist() for s in shard])), dtype=object).astype(str), axis=0, return_inverse=True) if len(score) else (None, np.zeros(0, int))
            else:
                group = np.zeros(len(score), int)
            take = np.zeros(len(score), bool)
            for g in np.unique(group):
                at = np.flatnonzero((group == g) & ok)
                if len(at) > k:
                    at = at[score[at] <= np.partition(score[at], k - 1)[k - 1]]
                take[at] = True
            mask = pa.array(take)
            yield pa.RecordBatch.from_arrays([*[c.filter(mask) for c in batch.columns[:-1]], pa.array(score[take])], names)

    return vectors.select(*keep, embedding).mapInArrow(run, schema)


def top_by_shard(scored: DataFrame, shard: Sequence[str], k: int, tie: Sequence[str]) -> DataFrame:
    """The k best of each shard; ties go to the smaller id. WindowGroupLimit cuts before the shuffle."""
    if k < 0:
        raise InvalidArgument("k must not be negative")
    w = Window.partitionBy(*shard).orderBy("score", *tie)
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def within(scored: DataFrame, threshold: float | None) -> DataFrame:
    """Scores up to and with the threshold; none means all."""
    return scored if threshold is None else scored.where(F.col("score") <= threshold)


def best_child(hits: DataFrame, parent: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One hit a parent, the best child. Parents are named with their shard: ids repeat in other shards."""
    w = Window.partitionBy(*parent).orderBy("score", *tie)
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def retrieve(children: DataFrame | None, parents: DataFrame, scored: DataFrame, max_results: int, threshold: float | None = None) -> DataFrame:
    """document_id, chunk_index, content, score: the chain from scored children to parents' contents.

    scored: index_name, shard_number, child_chunk_id, score. k is max_results children a shard, so that fewer than
    max_results parents can come out. Hits whose child or parent is missing are skipped. max_results of 0 gives none.
    Scored rows that carry parent_chunk_id need no children; parents with loaded_at are versions, of which the one loaded
    last counts.
    """
    shard = ("index_name", "shard_number")
    hits = within(top_by_shard(scored, shard, max_results, ("child_chunk_id",)), threshold)
    # hits are at most k a shard; AQE sees their size and broadcasts them
    linked = hits.select(*shard, "child_chunk_id", "parent_chunk_id", "score") if children is None else hits.select(*shard, "child_chunk_id", "score").join(children.select(*shard, "child_chunk_id", "parent_chunk_id"), [*shard, "child_chunk_id"])
    best = best_child(linked.where("parent_chunk_id IS NOT NULL"), (*shard, "parent_chunk_id"), ("child_chunk_id",))
    if "loaded_at" in parents.columns:  # contents of hits only are compared
        wanted = parents.join(best.select(*shard, "parent_chunk_id"), [*shard, "parent_chunk_id"], "left_semi")
        parents = live_rows(wanted, (*shard, "parent_chunk_id"), ("document_id", "chunk_index", "content"))
    full = best.join(parents.select(*shard, "parent_chunk_id", "document_id", "chunk_index", "content"), [*shard, "parent_chunk_id"])
    return full.orderBy("score", *shard, "child_chunk_id").limit(max_results).select("document_id", "chunk_index", "content", "score")


def of_index(indices: DataFrame, name: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables' rows of one index; the condition reaches their scans. Raises NotFound where the catalogue doesn't have it."""
    if indices.where(F.col("index_name") == name).isEmpty():
        raise NotFound(f"no index {name}")
    return [t.where(F.col("index_name") == name) for t in tables]


def score_live(vectors: DataFrame, query: DataFrame, key: Sequence[str], columns: Sequence[str] = (), embedding: str = "embedding") -> DataFrame:
    """key, columns, score of the live row of each key: of the rows without deleted_at the one loaded last.

    Rows are scored where they are read, so that only keys and scores are shuffled, never vectors. A live row whose vector
    can't be compared has no score and hides older rows of its key. Ties of loaded_at go to the greater columns and score.
    """
    near = vectors.where("deleted_at IS NULL").crossJoin(F.broadcast(query)).select(*key, "loaded_at", *columns, squared_l2(F.col(embedding), F.col("q")).alias("score"))
    last = near.groupBy(*key).agg(F.max(F.struct("loaded_at", *columns, "score")).alias("last"))
    out = last.select(*key, *[F.col(f"last.{c}").alias(c) for c in (*columns, "score")])
    return out.where(F.col("score").isNotNull() & ~F.isnan("score"))


def live_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One live row a key: of the rows without deleted_at the one loaded last. Ties go to the greater columns."""
    last = F.max(F.struct("loaded_at", *columns)).alias("last")
    return df.where("deleted_at IS NULL").groupBy(*key).agg(last).select(*key, *[F.col(f"last.{c}").alias(c) for c in columns])
