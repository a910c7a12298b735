import itertools

import pytest

from shardloom.operators.orphans import orphan_references

VALUES = [None, "a", "b"]
REFS = [(i, *k) for i, k in enumerate(itertools.product(VALUES, VALUES, [None, 1]))]
TARGETS = [("a", "a", 1), ("a", "a", 1), ("b", None, 1), (None, None, None)]


def judge(key, match):
    """Whether the reference is an orphan, by the definition."""
    nulls = [v is None for v in key]
    if not any(nulls):
        return key not in [t for t in TARGETS]
    if match == "simple":
        return False
    if match == "strict":
        return True
    if all(nulls):
        return False
    if match == "full":
        return True
    used = [i for i, n in enumerate(nulls) if not n]
    return not any(all(t[i] == key[i] for i in used) for t in TARGETS)


@pytest.mark.parametrize("match", ["simple", "partial", "full", "strict"])
def test_against_definition(spark, match):
    refs = spark.createDataFrame(REFS, "id int, x string, y string, z int")
    targets = spark.createDataFrame(TARGETS, "x string, y string, z int")
    got = {r.id for r in orphan_references(refs, targets, ("x", "y", "z"), match=match).collect()}
    assert got == {i for i, *k in REFS if judge(tuple(k), match)}


def test_empty_and_repeated(spark):
    refs = spark.createDataFrame([(1, "a", "t0"), (1, "a", "t0")], "id int, x string, _t0 string")
    none = spark.createDataFrame([], "x string, id int")
    assert orphan_references(refs, none, ("x",)).count() == 2
    assert orphan_references(refs.limit(0), none, ("x",)).count() == 0
    assert orphan_references(refs, spark.createDataFrame([("a", 7)], "x string, id int"), ("x",)).count() == 0


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        orphan_references(spark.range(1), spark.range(1), ("id",), match="some")
