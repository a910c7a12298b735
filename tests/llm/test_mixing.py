import numpy as np
import pytest

from shardloom.llm.mixing import mix_sources, pivot, reached_shares, settle_large, sized_texts

SIZED = "doc_id long, source string, h1 long, h2 long, n_tokens long, copies int"
TARGET = "mix_name string, source string, target_share double, max_repeats int, budget_ratio double"


def sized(spark, rows):
    return spark.createDataFrame([(d, s, h, h, n, 1) for d, s, h, n in rows], SIZED)


def test_shares_and_caps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else ("small" if i % 10 == 0 else "mid"), i, int(rng.integers(20, 400))) for i in range(6000)] + [(9000 + i, None, -i - 1, 100) for i in range(50)]
    s = sized(spark, rows).repartition(5)
    targets = spark.createDataFrame([("m", "hot", 0.3, 2, 0.8), ("m", "small", 0.4, 3, 0.8), ("m", "mid", 0.25, 4, 0.8), ("m", "none", 0.05, 2, 0.8), ("z", "hot", None, None, 0.5)], TARGET)
    mixed = mix_sources(s, targets, leaf_texts=200, fan=3).cache()
    total = sum(n for *_, n in rows)
    held = {k: sum(n for _, src, _, n in rows if src == k) for k in ("hot", "small", "mid")}
    got = {(r.mix_name, r.source): r for r in reached_shares(mixed, s, targets).collect()}
    for source, share, most in (("hot", 0.3, 2), ("small", 0.4, 3), ("mid", 0.25, 4)):
        want = min(share * 0.8 * total, most * held[source])
        assert abs(got["m", source].reached_tokens - want) <= 400  # the largest text
        assert got["m", source].most_copies <= most
    assert got["m", "small"].reached_tokens == 3 * held["small"]
    assert got["m", "none"].reached_tokens == 0 and got["z", "hot"].reached_tokens == 0
    assert abs(sum(got["m", k].reached_share for k in ("hot", "small", "mid")) - 1) < 1e-9
    again = mix_sources(s.repartition(3), targets, leaf_texts=200, fan=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_equal_texts_count_once(spark):
    s = sized(spark, [(1, "a", 7, 10), (2, "a", 7, 10), (3, "b", 7, 10), (4, "b", 8, 10), (5, "b", 9, 0)])
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 9.0), ("m", "b", 0.5, 2, 9.0)], TARGET)
    assert {(r.doc_id, r.copies) for r in mix_sources(s, targets).collect()} == {(1, 1), (4, 2)}


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], TARGET)
    none = sized(spark, [])
    assert mix_sources(none, targets).count() == 0
    r = reached_shares(mix_sources(none, targets), none, targets).first()
    assert (r.reached_tokens, r.texts) == (0, 0)
    assert mix_sources(sized(spark, [(1, "a", 1, 5)]), targets.limit(0)).count() == 0


@pytest.mark.parametrize("p,size", [([0.5] * 9, [1] * 9), ([0.1, 0.9, 0.3, 0.7], [9, 4, 4, 1]), ([0.0, 1.0, 0.2], [3, 2, 1]), ([0.25] * 4, [100, 10, 5, 1]), ([], [])])
def test_pivot_keeps_mass_and_expectation(p, size):
    rng = np.random.default_rng(0)
    total = np.zeros(len(p))
    for _ in range(3000):
        out, hold = pivot(np.array(p), np.array(size), rng)
        assert abs((out * size).sum() - np.dot(p, size)) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != hold)
        total += out
    assert np.allclose(total / 3000, p, atol=0.04)


def test_large_texts_meet_the_pool():
    rng = np.random.default_rng(5)
    size = np.array([5000, 900] + [40] * 400)
    p = np.full(len(size), 0.3)
    total, mass = np.zeros(len(p)), float(np.dot(p, size))
    for _ in range(2000):
        out = settle_large(p, size, rng)
        assert out[0] in (0.0, 1.0) and abs(np.dot(out, size) - mass) < 1e-6
        done, hold = pivot(out, size, rng)
        assert hold < 0 or size[hold] == 40
        total += out
    assert np.allclose(total / 2000, 0.3, atol=0.04)


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "a", "Hello  world"), (2, "a", None), (3, None, " \n"), (4, "b", ""), (5, "b", "<|endoftext|> ü")], "doc_id long, source string, text string")
    plain = {r.doc_id: r.n_tokens for r in sized_texts(docs, None).collect()}
    assert plain == {1: 2, 2: 0, 3: 0, 4: 0, 5: 2}
    bpe = {r.doc_id: r.n_tokens for r in sized_texts(docs).collect()}
    assert bpe[1] == 3 and bpe[2] == bpe[3] == bpe[4] == 0 and bpe[5] > 3


def test_shortfalls(spark):
    """One source holds a tenth of its share, one nothing: the others keep their size, fill up in proportion, or all shrink."""
    rows = [(i, "few", 2 * i + 1, 0, 10) for i in range(10)] + [(1000 + i, "big", 2 * i + 1, 1, 10) for i in range(3000)] + [(9000 + i, "mid", 2 * i + 1, 2, 10) for i in range(500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, h1 long, h2 long, n_tokens long")
    ratio = 10_000 / 35_100
    targets = spark.createDataFrame([("m", "few", 0.1, 1, ratio), ("m", "big", 0.5, 1, ratio), ("m", "mid", 0.3, 2, ratio), ("m", "none", 0.1, 5, ratio)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    got = {w: {r.source: r.reached_tokens for r in reached_shares(mix_sources(sized, targets, shortfall=w), sized, targets).collect()} for w in ("leave", "fill", "scale")}
    assert got["leave"] == {"few": 100, "big": 5000, "mid": 3000, "none": 0}
    assert got["fill"]["few"] == 100 and abs(got["fill"]["big"] - 9900 * 5 / 8) <= 10 and abs(sum(got["fill"].values()) - 10_000) <= 20
    assert got["scale"] == {"few": 100, "big": 500, "mid": 300, "none": 0}
    with pytest.raises(ValueError):
        mix_sources(sized, targets, shortfall="drop")
    # more than all can give: every source gives what it has
    huge = targets.withColumn("budget_ratio", targets.budget_ratio * 100)
    most = {r.source: r.reached_tokens for r in reached_shares(mix_sources(sized, huge, shortfall="fill"), sized, huge).collect()}
    assert most == {"few": 100, "big": 30_000, "mid": 10_000, "none": 0}
