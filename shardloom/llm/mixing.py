"""Mixing sources to target weights by pivotal rounding over a reduction tree.

A text of source s is wanted c = min(max_repeats, wanted size of s / size of s) times on average. It gets floor(c)
copies and one more with the probability of the rest. The rests are rounded dependently: two texts meet, and one hands
its mass (probability times size) to the other at random, in such a way that each keeps its expectation, until one is
out or in. Texts too large for such steps meet the pool of all smaller ones first. The mass of a source never changes, so that its reached size is the wanted one but for the last text. A leaf
of the tree ends with at most one text undecided; these meet again in the next level of the tree. The last one of a
source is drawn by its rest.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.sources.scratch import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_TEXTS = 10_000
FAN = 1_000
# Fixed value: the public pattern that cuts a text before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*batch.schema.names[:-1], "n_tokens"])

    return run


def sized_texts(documents: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """doc_id, source, h1, h2 (hashes of the text), n_tokens: of every row, null and blank texts with size 0.

    Sizes are tokens of the public vocabulary at `vocabulary`, or, with None, longest runs without white space.
    """
    head = documents.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.when(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")) != "", F.col("text")).alias("text"))
    if vocabulary is None:
        return head.select("doc_id", "source", "h1", "h2", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), 0)), F.lit(0)).cast("long").alias("n_tokens")).withColumn("n_tokens", F.greatest("n_tokens", F.lit(0).cast("long")))
    return head.mapInArrow(_count_tokens(vocabulary), "doc_id long, source string, h1 long, h2 long, n_tokens long")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds the probabilities in order; returns them and the place of the one left undecided, or -1.

    The mass of a text is its probability times its size. Of two undecided texts one hands mass to the other until one
    of them is 0 or whole; which way is drawn so that both keep their expectation. The sum of masses never changes.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    eps, hold = 1e-9, -1
    for i in range(len(p)):
        if min(p[i], 1 - p[i]) < eps:
            p[i] = round(p[i])
            continue
        if hold < 0:
            hold = i
            continue
        na, nb = size[hold], size[i]
        ma, mb = p[hold] * na, p[i] * nb
        up, down = min(na - ma, mb), min(ma, nb - mb)
        step = up if draws[i] * (up + down) < down else -down
        p[hold], p[i] = (ma + step) / na, (mb - step) / nb
        open_ = []
        for j in (hold, i):
            if min(p[j], 1 - p[j]) < eps:
                p[j] = round(p[j])
            else:
                open_.append(j)
        hold = open_[-1] if open_ else -1
    return p, hold


def settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the texts at the head, sorted by falling size, that pairwise steps among the smaller ones can't.

    All p must be equal. Such a text's partner is the pool of all smaller texts: it goes in with its probability, and the
    pool takes or gives the difference in mass evenly, which keeps the pool's probabilities equal and in expectation.
    It ends where the rest can resolve a text by itself, or where the pool is too small to answer for it.
    """
    p = p.astype(float).copy()
    if len(p) < 3 or not 0 < p[0] < 1:
        return p
    size = size.astype(float)
    below = np.cumsum(size[::-1])[::-1]
    squares = np.cumsum((size * size)[::-1])[::-1]
    now = p[0]
    for i in range(len(p) - 1):
        pool = below[i + 1]
        if size[i] ** 2 < 0.02 * squares[i + 1]:
            break
        fewer, more = now - size[i] * (1 - now) / pool, now + size[i] * now / pool
        if fewer <= 0 or more >= 1:
            break
        p[i] = float(rng.random() < now)
        now = fewer if p[i] else more
        p[i + 1 :] = now
    return p


_UNIT = "mix_name string, source string, node long, doc_id long, n_tokens long, base int, rest double, open boolean"


def _level(seed: int, leaf: bool, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # large texts first: what is left undecided is then a small one
        rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(repr(key), seed))
        rest, size = rows["rest"].to_numpy(), rows["n_tokens"].to_numpy()
        rest, hold = pivot(settle_large(rest, size, rng) if leaf else rest, size, rng)
        if last and hold >= 0:
            rest[hold], hold = float(rng.random() < rest[hold]), -1
        return rows.assign(rest=rest, open=np.arange(len(rows)) == hold)

    return run


def _level_of(wanted: DataFrame, shortfall: str) -> DataFrame:
    """mix_name, level: what each unit of wanted size is given, before a source's bound cuts it.

    wanted: mix_name, wanted, bound (the tokens that a source can give at most), a row a target. One pass over the sources of a
    mix in order of bound / wanted: below the level all give their bound, above it all give level * wanted.
    """
    rows = wanted.where("wanted > 0").withColumn("ratio", F.col("bound") / F.col("wanted"))
    if shortfall == "scale":  # all sources that hold anything reach their share of a smaller total
        held = rows.where("bound > 0")
        return held.groupBy("mix_name").agg(F.least(F.lit(1.0), F.min("ratio")).alias("level"))
    before = Window.partitionBy("mix_name").orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("mix_name")
    spent, passed = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("bound", "wanted"))
    level = (F.sum("wanted").over(total) - spent) / (F.sum("wanted").over(total) - passed)
    fits = rows.withColumn("level", level).where("level <= ratio")
    return fits.groupBy("mix_name").agg(F.min_by("level", F.struct("ratio", "source")).alias("level"))


SHORTFALLS = ("leave", "fill", "scale")


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 17, leaf_texts: int = LEAF_TEXTS, fan: int = FAN, shortfall: str = "leave") -> DataFrame:
    """mix_name, doc_id, source, n_tokens, copies: the texts of each mix, copies at least 1.

    sized: doc_id, source, h1, h2, n_tokens; targets: mix_name, source, target_share, max_repeats, budget_ratio.
    Equal texts count once a mix, under their smallest doc_id within the mix's sources, so that no text exceeds
    max_repeats. Rows without source, without size, or of sources outside a mix take no part in it, but count for the
    size of all documents that budget_ratio refers to. A null share counts as 0, null max_repeats as 1. Same seed, same
    result.

    A source that cannot reach its share even with all its repeats stays below it. What becomes of the rest is stated by
    `shortfall`: leave - the other sources keep their wanted size, and the mix is smaller; fill - what is missing is
    taken from the others in proportion to their shares, as far as they can give it, so that the mix has its wanted
    size; scale - the mix is made so much smaller that every source that has anything reaches its share of it.
    """
    if shortfall not in SHORTFALLS:
        raise ValueError(f"shortfall must be one of {SHORTFALLS}")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))  # one row
    wanted = targets.crossJoin(F.broadcast(total)).select("mix_name", "source", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"), (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("budget_ratio", F.lit(0.0)) * F.col("total")).alias("wanted"))
    usable = sized.where("n_tokens > 0").join(wanted.select("mix_name", "source"), "source")
    texts = usable.groupBy("mix_name", "h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t")).select("mix_name", "t.*")
    texts = materialize(texts, "mix-texts")
    held = texts.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("texts"))
    bounded = held.join(wanted, ["mix_name", "source"]).withColumn("bound", (F.col("most") * F.col("held")).cast("double"))
    if shortfall == "leave":
        bounded = bounded.withColumn("level", F.lit(1.0))
    else:
        every = wanted.join(bounded.select("mix_name", "source", "bound"), ["mix_name", "source"], "left").select("mix_name", "source", "wanted", F.coalesce("bound", F.lit(0.0)).alias("bound"))
        # no level: all sources give what they can
        bounded = bounded.join(_level_of(materialize(every, "mix-bounds"), shortfall), "mix_name", "left").withColumn("level", F.coalesce("level", F.lit(float("inf"))))
    rate = F.when(F.col("wanted") > 0, F.least(F.col("most").cast("double"), F.col("level") * F.col("wanted") / F.col("held"))).otherwise(0.0)
    leaves = F.ceil(F.col("texts") / leaf_texts)
    rates = materialize(bounded.select("mix_name", "source", rate.alias("rate"), leaves.alias("leaves")), "mix-rates")
    most = rates.agg(F.max("leaves")).first()[0] or 1  # one number: the width of the tree
    units = texts.join(rates, ["mix_name", "source"]).select(
        "mix_name", "source", F.pmod(F.xxhash64("doc_id"), F.col("leaves")).alias("node"), "doc_id", "n_tokens",
        F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("rest"), F.lit(True).alias("open"))
    done = None
    for depth in range(1 + math.ceil(math.log(most, fan) - 1e-9) if most > 1 else 1):
        last = fan**depth >= most
        rounded = materialize(units.groupBy("mix_name", "source", "node").applyInPandas(_level(seed + depth, depth == 0, last), _UNIT), "mix-level")
        closed = rounded.where("NOT open")
        done = closed if done is None else done.unionByName(closed)
        units = rounded.where("open").withColumn("node", F.floor(F.col("node") / fan).cast("long"))
    copies = (F.col("base") + F.round("rest").cast("int")).alias("copies")
    return done.select("mix_name", "doc_id", "source", "n_tokens", copies).where("copies > 0")


def promised_totals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """shortfall, mix_name, promised, slack: the size that each way with shortfalls gives each mix, from what its sources hold.

    Rounding leaves one text a source undecided, so sizes are met up to slack, the sum of the sources' largest texts.
    """
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    wanted = targets.crossJoin(F.broadcast(total)).select("mix_name", "source", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"), (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("budget_ratio", F.lit(0.0)) * F.col("total")).alias("wanted"))
    texts = sized.where("n_tokens > 0").join(wanted.select("mix_name", "source"), "source").groupBy("mix_name", "h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t"))
    held = texts.groupBy("mix_name", F.col("t.source").alias("source")).agg(F.sum("t.n_tokens").alias("held"), F.max("t.n_tokens").alias("largest"))
    rows = wanted.join(held, ["mix_name", "source"], "left").withColumn("bound", F.col("most") * F.coalesce("held", F.lit(0)))
    some = (F.col("bound") > 0) & (F.col("wanted") > 0)
    by = rows.groupBy("mix_name").agg(
        F.sum(F.least("wanted", "bound")).alias("leave"), F.least(F.sum("wanted"), F.sum(F.when(F.col("wanted") > 0, F.col("bound")))).alias("fill"),
        (F.least(F.lit(1.0), F.min(F.when(some, F.col("bound") / F.col("wanted")))) * F.sum(F.when(some, F.col("wanted")))).alias("scale"), F.coalesce(F.sum("largest"), F.lit(0)).alias("slack"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("shortfall"), F.coalesce(F.col(k), F.lit(0.0)).alias("promised")) for k in SHORTFALLS])).alias("e")
    return by.select("mix_name", "slack", each).select("e.shortfall", "mix_name", "e.promised", "slack")


def reached_totals(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, reached_tokens, over: the size of each mix, and how many of its texts stand in it more often than they may."""
    most = targets.select("mix_name", "source", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("most"))
    used = mixed.join(most, ["mix_name", "source"]).groupBy("mix_name").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"), F.count_if(F.col("copies") > F.col("most")).alias("over"))
    return targets.select("mix_name").distinct().join(used, "mix_name", "left").select("mix_name", F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), F.coalesce("over", F.lit(0)).alias("over"))


def reached_shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a target: wanted and reached size and share, texts used and the most copies of one."""
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    used = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    every = used.groupBy("mix_name").agg(F.sum("reached").alias("mix_size"))
    rows = targets.crossJoin(F.broadcast(total)).join(used, ["mix_name", "source"], "left").join(every, "mix_name", "left")
    reached = F.coalesce("reached", F.lit(0))
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", (F.col("target_share") * F.col("budget_ratio") * F.col("total")).alias("wanted_tokens"), reached.alias("reached_tokens"),
        (reached / F.col("mix_size")).alias("reached_share"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
