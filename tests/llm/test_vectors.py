import random

import numpy as np
import pyarrow.dataset as ds

from shardloom.llm import vectors
from shardloom.llm.queries import p5_found, p5_neighbours
from shardloom.llm.vectors import most_similar, pivot_count

SCHEMA = "vec_id long, embedding array<float>, h int, cosine string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


def exact(rows, queries, k, dim):
    x = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == dim and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    out = {}
    for q in queries:
        if q in x:
            s = np.round(m @ (x[q] / np.linalg.norm(x[q])), 12)
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
            out[q] = [ids[i] for i in order]
    return out


def clustered(n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, dim))
    return [(i, [float(np.float32(a)) for a in centres[i % len(centres)] + 0.3 * rng.normal(size=dim)]) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered(3000)
    queries = [i for i, _ in rows if i % 100 == 0]
    want = exact(rows, queries, 10, 64)
    found = most_similar(frame(spark, rows + rows[:40]).repartition(4), spark.createDataFrame([(q,) for q in queries], "vec_id long"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id))
    assert all(len(v) == 10 for v in got.values()) and set(got) == set(want)
    hit = sum(len(set(want[q]) & {v for _, v in got[q]}) for q in want)
    assert hit >= 0.95 * 10 * len(want)


def test_recall_on_the_tables(spark, folder):
    t = ds.dataset(f"{folder}/child_chunks.parquet").to_table(columns=["vec_id", "embedding"]).to_pydict()
    rows = list(dict(zip(t["vec_id"], t["embedding"])).items())
    probes = ds.dataset(f"{folder}/knn_probes.parquet").to_table()["vec_id"].to_pylist()
    want = {(min(q, v), max(q, v)) for q, found in exact(rows, probes, 10, 64).items() for v in found}
    got = {tuple(r) for r in p5_found(spark, folder).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_recall_of_ordinary_vectors_on_the_tables(spark):
    """Ordinary vectors, whose neighbours are far: the 10 nearest of every vec_id % 100 = 0."""
    folder = "/root/testdata/sf0.01"
    t = ds.dataset(f"{folder}/child_chunks.parquet").to_table(columns=["vec_id", "embedding"]).to_pydict()
    rows = list(dict(zip(t["vec_id"], t["embedding"])).items())
    want = exact(rows, [i for i, _ in rows if i is not None and i % 100 == 0], 10, 64)
    got = {}
    for r in p5_neighbours(spark, folder).collect():
        got.setdefault(r["query"], []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * 10 * len(want)


def test_equal_vectors_around_every_query(spark):
    """200 equal vectors and 30 nearer and farther ones around each query, in files of the default size."""
    rng = np.random.default_rng(8)
    rows, queries = [], []
    for q in range(8):
        base = rng.normal(size=16)
        at = lambda d: [float(np.float32(a)) for a in base + d * rng.normal(size=16)]
        queries.append(10_000 * q)
        rows.append((10_000 * q, [float(np.float32(a)) for a in base]))
        copy = at(0.3)
        rows += [(10_000 * q + 1 + i, copy) for i in range(200)] + [(10_000 * q + 1000 + i, at(0.1 + 0.02 * i)) for i in range(30)]
    rows += [(900_000 + i, [float(np.float32(a)) for a in rng.normal(size=16)]) for i in range(2000)]
    want = exact(rows, queries, 10, 16)
    ask = spark.createDataFrame([(q,) for q in queries], "vec_id long")
    hits = {n: sum(r.vec_id in want[r["query"]] for r in most_similar(frame(spark, rows), ask, dim=16, file_rows=n).collect()) for n in (100, 50_000)}
    assert min(hits.values()) >= 0.95 * 80, hits


def test_footrule_cuts_what_the_files_hold(spark):
    """With few candidates kept by the footrule the nearest still come through."""
    rows = clustered(3000)
    queries = [i for i, _ in rows if i % 100 == 0]
    want = exact(rows, queries, 10, 64)
    found = most_similar(frame(spark, rows), spark.createDataFrame([(q,) for q in queries], "vec_id long"), pivots=64, rerank=60)
    assert sum(r.vec_id in want[r["query"]] for r in found.collect()) >= 0.9 * 10 * len(want)


def test_split_files_and_copies(spark):
    """A third of all vectors are equal; their files are split, and ties go to the smaller id."""
    rows = clustered(600, 16) + [(1000 + i, [1.0] * 16) for i in range(300)]
    random.Random(2).shuffle(rows)
    queries = spark.createDataFrame([(0,), (1000,), (1299,)], "vec_id long")
    got = {}
    for r in most_similar(frame(spark, rows), queries, k=5, dim=16, file_rows=40).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[1000])] == [1001, 1002, 1003, 1004, 1005]
    assert [v for _, v in sorted(got[1299])] == [1000, 1001, 1002, 1003, 1004]


def test_copies_push_nothing_out(spark, monkeypatch):
    """60 to 160 copies of the 10th neighbour of each query, in files of the default size: the nine before it stay in the list of the index."""
    rows = clustered(3000)
    queries = list(range(60))  # of 60 clusters
    near = exact(rows, queries, 10, 64)
    vector = dict(rows)
    for q in queries:
        rows += [(10_000 + 1000 * q + i, vector[near[q][9]]) for i in range(60 + 100 * (q % 2))]
    seen = {}
    keep = vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda df, name, *a: seen.setdefault(name, keep(df, name, *a)))
    got = {}
    for r in most_similar(frame(spark, rows).repartition(4), spark.createDataFrame([(q,) for q in queries], "vec_id long")).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(found)] for q, found in got.items()} == exact(rows, queries, 10, 64)
    listed = {(r["query"], r.vec_id) for r in seen["candidates"].collect()}
    stay = sum((q, v) in listed for q in queries for v in near[q][:9])
    assert stay >= 0.99 * 9 * len(queries), stay


def test_unusable_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [1.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (10, [1e-30, 0.0]), (None, [1.0, 0.0]), (11, [3e38, 3e38])]
    ask = spark.createDataFrame([(1,), (1,), (3,), (99,), (None,), (11,)], "vec_id long")
    got = sorted((r["query"], r["rank"], r.vec_id, round(r.cosine, 6)) for r in most_similar(frame(spark, rows), ask, dim=2).collect())
    half = round(0.5**0.5, 6)
    assert got == [(1, 1, 10, 1.0), (1, 2, 2, half), (1, 3, 11, half), (11, 1, 2, 1.0), (11, 2, 1, half), (11, 3, 10, half)]
    assert most_similar(frame(spark, []), ask, dim=2).count() == 0
    assert most_similar(frame(spark, rows), ask.limit(0), dim=2).count() == 0


def test_pivots_are_bounded():
    assert pivot_count(0) == 64 and pivot_count(438_000) == 4096 and pivot_count(10**12) == 32_000


def test_few_usable_among_many(spark):
    bad = spark.range(3000).selectExpr("id AS vec_id", "CAST(array() AS array<float>) AS embedding")
    good = spark.createDataFrame([(5001, [1.0, 0.0]), (5002, [0.9, 0.1]), (5003, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = most_similar(bad.unionByName(good), good.select("vec_id"), k=1, dim=2)
    assert {(r["query"], r.vec_id) for r in found.collect()} == {(5001, 5002), (5002, 5001), (5003, 5002)}
