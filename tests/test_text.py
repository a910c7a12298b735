import re

import pytest
from pyspark.sql import functions as F

from shardloom.functions.text import chunk_text, chunks, from_urlsafe, tokens, urlsafe


def reference(text, size, lap):
    t = re.findall(r"[^ \t\n\r\f]+", text)
    out, i = [], 0
    while t:
        out.append(t[i : i + size])
        if i + size >= len(t):
            break
        i += size - lap
    return out


TEXTS = ["", "  \t\n", " lead word"] + [" ".join(f"w{i}" for i in range(n)) for n in (1, 4, 5, 6, 8, 10, 11, 14)]


@pytest.mark.parametrize("size,lap", [(5, 0), (5, 2), (5, 4), (1, 0)])
def test_chunks(spark, size, lap):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", F.transform(chunks(tokens(F.col("t")), F.lit(size), F.lit(lap)), chunk_text).alias("c")).collect()
    for r in got:
        assert [x.split() for x in r.c] == reference(r.t, size, lap), r.t


def test_invalid_sizes_give_null(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (5, -1), (None, 0), (5, None)], "s int, o int")
    assert all(r[0] is None for r in df.select(chunks(tokens(F.lit("a b")), F.col("s"), F.col("o"))).collect())


def test_white_space_inside_stays(spark):
    got = spark.range(1).select(chunks(tokens(F.lit(" a  b\n\nc d")), F.lit(2), F.lit(0)).alias("c")).select(F.transform("c", chunk_text)).first()[0]
    assert got == ["a  b", "c d"]


def test_urlsafe(spark):
    import base64

    words = ["", "ü?>>~~", "x" * 200, "a"]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", urlsafe(F.col("w")).alias("c"), from_urlsafe(urlsafe(F.col("w"))).alias("b")).collect():
        assert r.c == base64.urlsafe_b64encode(r.w.encode()).decode() and r.b == r.w
