"""Most similar vectors: a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its first `posted`
pivots, with that order and a code of one byte a dimension. A query reads the files of its first `read` pivots. In each
it ranks what it finds by the footrule distance of the two orders (a pivot missing in one order stands at its end), keeps
the best `rerank`, and ranks these again by the cosine of the codes; the best of all its files are ranked at last by the
exact cosine of the vectors. A vector found in several files is judged in the first of them that the query reads.

The pivots are a bounded sample (at most `MOST_PIVOTS` vectors, chosen by hash). Their number and `rerank` grow with the
square root of the collection, so that a query's work does, too; from some 30 million vectors on the pivots stay, and the
files grow with the collection. Files longer than `FILE_ROWS` are split into parts that are searched by separate tasks.
Of equal vectors the k + 1 with the smallest ids are posted, whatever the size of the files: they decide every answer,
since ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.sources.scratch import materialize

MOST_PIVOTS = 32_000
FILE_ROWS = 50_000
ORDER = 24
POSTED = 5
READ = 20
#: Candidates of a file, at least and by the square root of the rows, that are ranked by their codes.
RERANK, RERANK_ROOTS = 500, 2
#: Candidates by codes that are ranked by their exact cosines, in multiples of k.
EXACT = 3
#: Queries of a file that are compared at once.
ASKED = 64


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, embedding of the vectors that can be compared: of `dim` finite numbers, not all zero. Null ids aren't."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0)).select("vec_id", "embedding")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _orders(pivots: np.ndarray, order: int, posted: int):
    """Rows vec_id, h (hash of the vector), files (the first pivots), places (int16, nearest first), code (int8)."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            x = _matrix(batch.column(1), dim)
            s = x @ pivots.T
            k = min(order, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1).astype("<i2")
            code = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
            files = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * posted + 1, posted), pa.int32()), pa.array(near[:, :posted].astype(np.int32).ravel(), pa.int32()))
            columns = [batch.column(0), batch.column(2), files, *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (near, code)]]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "h", "files", "places", "code"])

    return run


def _search(posted: int, read: int, rerank: int, best: int, pivots: int):
    """Of a file, the best of each query that reads it: query, vec_id, near (the cosine of the codes)."""

    def stacked(column: pd.Series, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)

    def coded(column: pd.Series) -> np.ndarray:
        m = stacked(column, np.int8).astype(np.float32)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(key: tuple, posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "vec_id": [], "near": []}).astype({"query": "int64", "vec_id": "int64", "near": "float32"})
        if not len(posts) or not len(asks):
            return none
        posts = posts.drop_duplicates("vec_id")  # rows that repeat a vector count once
        ids, order, m = posts["vec_id"].to_numpy(), stacked(posts["places"], "<i2").astype(np.int64), coded(posts["code"])
        queries, asked, v = asks["query"].to_numpy(), stacked(asks["order"], "<i2").astype(np.int64), coded(asks["ask_code"])
        k = order.shape[1]
        ranks = np.arange(k)
        out = []
        for i in range(0, len(queries), ASKED):
            q, mine = asked[i : i + ASKED], queries[i : i + ASKED]
            rows = np.arange(len(q))
            place = np.full((len(q), pivots), k, np.int16)
            place[rows[:, None], q] = ranks
            # judged in the first file that both share: the least place in the query among the files of the vector
            first = place[:, order[:, 0]]
            for j in range(1, posted):
                first = np.minimum(first, place[:, order[:, j]])
            near = np.where((first == place[:, key[0]][:, None]) & (ids != mine[:, None]), v[i : i + ASKED] @ m.T, np.float32(-9))
            for r in np.flatnonzero((near > -9).sum(1) > rerank):
                some = np.flatnonzero(near[r] > -9)
                there = place[r, order[some]].astype(np.int64)
                # footrule: places of pivots in both, and the distance to the end for those in one
                distance = np.abs(there - ranks).sum(1) + (k - ranks).sum() - (k - there).sum(1)
                far = np.lexsort((ids[some], distance))[rerank:]
                near[r, some[far]] = -9
            if near.shape[1] > best:
                cut = -np.partition(-near, best - 1, axis=1)[:, best - 1]
                near[near < cut[:, None]] = -9
            r, c = np.nonzero(near > -9)
            out.append((mine[r], ids[c], near[r, c]))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query": a, "vec_id": b, "near": c})

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision."""
    x, y = (m.astype(np.float64) for m in (x, y))
    x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _cosine(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosines(x, y), pa.float64())], ["query", "vec_id", "cosine"])

    return run


def pivot_count(rows: int) -> int:
    """Six times the square root of the rows, as a power of 2 from 64 up, at most MOST_PIVOTS."""
    return min(MOST_PIVOTS, max(64, 2 ** round(math.log2(6 * math.sqrt(max(rows, 1))))))


def most_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, pivots: int | None = None, order: int = ORDER, posted: int = POSTED, read: int = READ, rerank: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """query, vec_id, cosine, rank: for each vec_id of `queries` its k most similar other vectors of `vectors`.

    vectors: vec_id, embedding. Ties of the cosine go to the smaller vec_id. Rows that repeat a vec_id count once, by
    the most similar of their vectors.
    Vectors that are null, of another length than dim, all zero or not finite take no part, as queries neither; a query
    whose id has no vector has no rows. Fewer than k other vectors give fewer rows, an empty table none.
    Cosines are exact, but a neighbour whose order of pivots differs much from the query's can be missed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim)
    total = vectors.count()
    wanted = pivots or pivot_count(total)
    rerank = rerank or max(RERANK, math.ceil(RERANK_ROOTS * math.sqrt(total)))
    # the hash range holds some four times as many vectors as wanted, so that no task sends the driver more than its share
    h, whole = F.xxhash64("vec_id"), 1 << 30
    part = min(whole, math.ceil(whole * 4 * (wanted + 16) / max(total, 1)))
    draw = lambda df: df.select("embedding").orderBy(h, "vec_id").limit(wanted).collect()  # noqa: E731 - bounded by MOST_PIVOTS
    sample = draw(rows.where(F.pmod(h, F.lit(whole)) < part))
    if len(sample) < wanted and part < whole:  # few rows are usable
        sample = draw(rows)
    if not sample:
        return spark.createDataFrame([], "query long, vec_id long, cosine double, rank int")
    p = np.unique(np.array([r[0] for r in sample], np.float32), axis=0)
    p = _unit(p)
    order = min(order, len(p))
    posted, read = min(posted, order), min(read, order)

    hashed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    # the first `read` pivots as numbers; the first `posted` of them are the files that hold the vector
    index = materialize(hashed.mapInArrow(_orders(p, order, max(posted, read)), "vec_id long, h long, files array<int>, places binary, code binary"), "orders")
    # of more than k + 1 equal vectors, the last id that is posted
    different = index.select("h", "vec_id").distinct()
    many = different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    among = different.join(many, "h").withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    last = materialize(among.groupBy("h").agg(F.max("vec_id").alias("last")), "equal")
    held = index.join(last, "h", "left").where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last")))

    # files that need several tasks, with their number of parts
    each = index.select(F.explode(F.slice("files", 1, posted)).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    long = materialize(each.where(F.col("n") > file_rows).select("file", F.ceil(F.col("n") / file_rows).cast("int").alias("parts")), "files")
    parts = F.coalesce("parts", F.lit(1))
    posts = held.select("vec_id", "places", "code", F.explode(F.slice("files", 1, posted)).alias("file")).join(long, "file", "left")
    posts = posts.select("file", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), "vec_id", "places", "code")
    # queries are looked up in the index itself: they have the same order there
    asked = index.withColumnRenamed("vec_id", "query").join(queries.select(F.col("vec_id").alias("query")).distinct(), "query", "left_semi").dropDuplicates(["query"])
    asks = asked.select("query", F.col("places").alias("order"), F.col("code").alias("ask_code"), F.explode(F.slice("files", 1, read)).alias("file")).join(long, "file", "left")
    asks = asks.select(F.col("file").alias("ask_file"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("ask_part"), "query", "order", "ask_code")
    search = _search(posted, read, rerank, EXACT * k, len(p))
    found = posts.groupBy("file", "part").cogroup(asks.groupBy("ask_file", "ask_part")).applyInPandas(search, "query long, vec_id long, near float")
    nearest = Window.partitionBy("query").orderBy(F.desc("near"), "vec_id")
    kept = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= EXACT * k).select("query", "vec_id")
    kept = materialize(kept, "candidates")

    one = rows.select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked")).join(kept.select("query").distinct(), "query", "left_semi").dropDuplicates(["query"])
    pairs = kept.join(one, "query").join(rows, "vec_id").select("query", "vec_id", "asked", "embedding")
    scored = pairs.mapInArrow(_cosine(dim), "query long, vec_id long, cosine double").groupBy("query", "vec_id").agg(F.max("cosine").alias("cosine"))
    top = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
