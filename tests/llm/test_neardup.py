import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from shardloom.llm.lexing import words
from shardloom.llm.neardup import NearDuplicates, _pack, _tally, _unpack, components

SCHEMA = "document_id string, title string, content string, loaded_at timestamp, cid long, payload string"
T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, c, T, 7, "clash") for d, t, c in rows], SCHEMA)


def brute(rows, similarity=0.5, width=3, least=20):
    sets = {}
    for d, t, c in rows:
        if len(words(c)) >= least:
            w = words(t) + words(c)
            sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            text = rng.choice(rows)[2].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            if rng.random() < 0.2:
                text = text[len(text) // 2 :] + text[: len(text) // 2]
        else:
            text = [rng.choice(vocabulary) for _ in range(rng.choice([20, 22, 30, 60, 200]))]
        rows.append((f"d{i:03d}", rng.choice([None, "", "A title"]), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,records,cells,similarity", [(1, 4_000, 8_000_000, 0.5), (2, 8, 8_000_000, 0.5), (3, 4_000, 150, 0.5), (4, 10, 100, 0.8)])
def test_equals_brute_force(spark, seed, records, cells, similarity):
    """Few buckets and many, whole ones and ones in shares."""
    rows = corpus(seed)
    near = NearDuplicates(frame(spark, rows + rows[:15]).repartition(5), similarity=similarity, bucket_records=records, bucket_cells=cells)
    want = brute(rows, similarity)
    assert {tuple(r) for r in near.pairs().collect()} == want
    if seed == 1:
        groups_ = near.groups().collect()
        links = {}
        for a, b in want:
            links[a] = links.get(a, 0) + 1
            links[b] = links.get(b, 0) + 1
        assert {r.document_id: r.links for r in groups_} == {r.document_id: links.get(r.document_id, 0) for r in groups_}
        root = {r.document_id: r.group_id for r in groups_}
        assert all(root[a] == root[b] for a, b in want)
        assert all(root[g] == g and g <= d for d, g in root.items())


def test_five_words_at_four_fifths(spark):
    rows = corpus(9)
    near = NearDuplicates(frame(spark, rows), similarity=0.8, width=5)
    assert {tuple(r) for r in near.pairs().collect()} == brute(rows, 0.8, 5)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    text = " ".join(f"y{i}" for i in range(30))
    rows = [("n", None, None), ("e", "t", ""), ("b", "t", " \n"), ("short", "t", "a b c"), ("l1", None, long), ("l2", "t", long + " more"), ("s1", None, text), ("s2", None, text.upper()), ("s3", "", text.replace(" ", "_ "))]
    near = NearDuplicates(frame(spark, rows))
    assert {tuple(r) for r in near.pairs().collect()} == {("l1", "l2"), ("s1", "s2"), ("s1", "s3"), ("s2", "s3")}
    assert {r.document_id for r in near.members.collect()} == {"l1", "l2", "s1", "s2", "s3"}
    empty = NearDuplicates(frame(spark, []))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0
    with pytest.raises(ValueError):
        NearDuplicates(frame(spark, []), similarity=0)


def test_latest_row_counts(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(30)) for p in "ab")
    rows = [("d", "", a, T, 0, ""), ("d", "", b, T + dt.timedelta(days=1), 0, ""), ("e", "", a, T, 0, ""), ("f", "", b, T, 0, "")]
    assert [tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()] == [("d", "f")]


def test_hot_group_of_copies(spark):
    text = " ".join(f"y{i}" for i in range(40))
    rows = [(f"c{i:03d}", None, text) for i in range(150)] + corpus(5, 60)
    near = NearDuplicates(frame(spark, rows).repartition(6))
    assert near.class_pairs.count() <= 59 * 58 / 2
    groups = {r.document_id: r for r in near.groups().collect()}
    assert all(groups[f"c{i:03d}"].group_id == "c000" and groups[f"c{i:03d}"].links == 149 for i in range(150))


def test_tally_in_steps():
    rng = np.random.default_rng(0)
    held = [np.unique(rng.integers(0, 30, rng.integers(1, 20))).astype(np.uint32) for _ in range(40)]
    cid, size = np.arange(40, dtype=np.int64) * 1000, np.full(40, 20, np.int32)
    raw = _pack(cid, size, np.zeros(40, np.int32), np.array([len(h) for h in held], np.int32), np.concatenate(held).astype(np.uint64))
    rows = pd.DataFrame({"payload": [raw, raw], "share": 0, "shares": 1})
    want = {(a * 1000, b * 1000): len(np.intersect1d(held[a], held[b])) for a in range(40) for b in range(a + 1, 40) if len(np.intersect1d(held[a], held[b]))}
    for step in (5, 1_000_000):
        got = {}
        for part in _tally(0.5, 3, step)((0, 0, 0), iter([rows])):
            for a, b, n, least in zip(part["a"], part["b"], part["n"], part["least"]):
                got[a, b] = got.get((a, b), 0) + n
                assert least == 3
        assert got == want


def test_packing():
    arrays = [np.arange(3, dtype=np.int64), np.array([], np.int32), np.array([7], np.uint32)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, _unpack(_pack(*arrays))))


def test_hot_cells_in_shares(spark):
    """Texts of their own that all hold one passage, and a third of all that differ by a word."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(12))
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(40)] if i % 3 else [*base[: i % 40], f"e{i}", *base[i % 40 + 1 :]]
        rows.append((f"d{i:02d}", None, " ".join(own) + " " + common))
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) == 30 * 29 / 2
    for cells in (60, 8_000_000):
        assert {tuple(r) for r in NearDuplicates(frame(spark, rows).repartition(3), bucket_cells=cells).pairs().collect()} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)]
    random.Random(1).shuffle(edges)
    got = {r.cid: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
