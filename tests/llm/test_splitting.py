import datetime as dt
import random
import re

import pytest

from shardloom.llm.splitting import KINDS, Chooser, choose_pieces, scan_range, split_files, split_oversized

T = dt.datetime(2025, 1, 1)
DOC = "document_id string, index_name string, content string, loaded_at timestamp, version int, piece int"
LIMIT = "index_name string, max_parent_chunk_size int, parent_chunk_overlap_size int"
TOKEN = re.compile(r"[^ \t\n\r\f]+")


def docs(spark, rows):
    return spark.createDataFrame([(d, i, c, T, 1, 1) for d, i, c in rows], DOC)


def random_text(rng, n):
    out = []
    for _ in range(n):
        word = "".join(rng.choice("abcdeéü…字😀") for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.15:
            word += rng.choice([".", "!", "?", '."', ".)", "…", ".»", ","])
        if rng.random() < 0.3:
            word = word.capitalize()
        out += [word, rng.choice([" ", " ", " ", "\n", "\n\n", "\r\n", "\f", " \t ", "\xa0", " " * 80])]
    return rng.choice(["", " ", "\n"]) + "".join(out)


def test_ranges_of_any_size_agree(spark):
    rng = random.Random(7)
    rows = [(f"d{i}", rng.choice("ab"), random_text(rng, rng.choice([1, 5, 12, 60, 300]))) for i in range(40)]
    limits = spark.createDataFrame([("a", 10, 3), ("b", 25, 0)], LIMIT)
    got = [sorted(map(tuple, split_oversized(docs(spark, rows + rows[:9]), limits, r).collect())) for r in (1_000_000, 300, 97)]
    assert got[0] == got[1] == got[2] and got[0]
    text, size = {d: c for d, _, c in rows}, {d: {"a": (10, 3), "b": (25, 0)}[i] for d, i, _ in rows}
    by = {}
    for r in got[0]:
        by.setdefault(r[0], []).append(r)
    for d, c in text.items():
        spans = [m.span() for m in TOKEN.finditer(c)]
        limit, overlap = size[d]
        assert (d in by) == (len(spans) > limit)
        if d not in by:
            continue
        starts, ends = [s for s, _ in spans], [e for _, e in spans]
        pieces = sorted(by[d], key=lambda r: r[2])
        at = [(starts.index(r[3]), ends.index(r[4]) + 1) for r in pieces]
        assert at[0][0] == 0 and at[-1][1] == len(spans)
        assert all(b - a == r[5] <= limit for (a, b), r in zip(at, pieces))
        assert all(y[0] == x[1] - overlap for x, y in zip(at, at[1:]))


def test_boundaries(spark):
    text = "One two. Three four five\n\nsix seven e.g. eight nine ten eleven twelve. Thirteen fourteen fifteen"
    limits = spark.createDataFrame([("a", 6, 1)], LIMIT)
    got = split_oversized(docs(spark, [("d", "a", text)]), limits).orderBy("piece").collect()
    assert [(text[r.start_char : r.end_char].split()[-1], r.boundary) for r in got] == [("five", "paragraph"), ("nine", "limit"), ("twelve.", "sentence"), ("fifteen", "end")]


def test_white_space_of_any_length(spark):
    """A sentence's, a paragraph's and a line's end before more than 64 blanks, within a range and across several."""
    def text(blanks):
        parts = ['one two three four five."', " " * blanks, "Six seven eight nine ten", "\n" + " " * blanks + "\n", "eleven twelve thirteen fourteen fifteen", "\r\n" + " " * blanks, "x y z"]
        return "".join(parts)
    rows = [(f"d{n}", "a", text(n)) for n in (1, 63, 64, 65, 100, 1000)]
    limits = spark.createDataFrame([("a", 6, 0)], LIMIT)
    for size in (1_000_000, 97, 300):
        by = {}
        for r in split_oversized(docs(spark, rows), limits, size).orderBy("piece").collect():
            by.setdefault(r.document_id, []).append((r.n_tokens, r.boundary))
        assert by == {d: [(5, "sentence"), (5, "paragraph"), (5, "line"), (3, "end")] for d, _, _ in rows}


def test_edge_cases(spark):
    rows = [("null", "a", None), ("empty", "a", ""), ("blank", "a", " \n\t "), ("limit", "a", "a b c"), ("over", "a", "a b c d"), ("none", "n", "a b c d"), ("zero", "z", "a b c d"), ("unknown", "q", "a b c d"), ("wide", "w", "a b c d"), ("minus", "m", "a b c d"), ("one", "a", "x" * 300_000), ("big", "a", "word " * 40_000), ("noname", None, "a b c d")]
    limits = spark.createDataFrame([("a", 3, 1), ("n", None, 1), ("z", 0, 0), ("w", 3, 9), ("m", 3, -2), (None, 1, 0)], LIMIT)
    got = split_oversized(docs(spark, rows), limits, 4096)
    by = {}
    for r in got.collect():
        by.setdefault(r.document_id, []).append(r)
    assert set(by) == {"over", "wide", "minus", "big"}
    assert len(by["wide"]) == 2 and len(by["minus"]) == 2 and len(by["big"]) == (40_000 - 3 + 1) // 2 + 1
    assert split_oversized(docs(spark, []), limits).count() == 0


def test_latest_row_counts(spark):
    rows = [("d", "a", "a b c d e", T, 1, 1), ("d", "a", "a b", T + dt.timedelta(1), 1, 1), ("e", "a", "a b c d e", None, 1, 1)]
    got = split_oversized(spark.createDataFrame(rows, DOC), spark.createDataFrame([("a", 3, 0)], LIMIT))
    assert {r.document_id for r in got.collect()} == {"e"}


def test_rows_without_id_have_pieces(spark):
    rows = [(None, "a", "a b c d"), (None, "a", "e f g h i j k"), (None, "a", "a b c d"), (None, "a", "a b"), (None, "a", "word " * 100), ("d", "a", "a b c d")]
    for size in (1_000_000, 64):
        got = split_oversized(docs(spark, rows), spark.createDataFrame([("a", 3, 0)], LIMIT), size).collect()
        assert sorted(r.piece for r in got if r.document_id is None) == sorted([*range(2), *range(3), *range(34)])
        assert sorted(r.piece for r in got if r.document_id == "d") == [0, 1]


@pytest.mark.parametrize("n,limit,overlap", [(1, 1, 0), (7, 1, 0), (7, 3, 2), (100, 7, 6), (3, 3, 1)])
def test_pieces_cover(n, limit, overlap):
    pieces = choose_pieces(n, [2, 5], [2, 3], limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    assert all(b - a <= limit for a, b, _ in pieces)
    assert all(y[0] == x[1] - min(overlap, limit - 1) and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))


def test_scan_counts_code_points():
    start, end, chars, _ = scan_range("é 字字 x".encode(), 0, 0)
    assert start.tolist() == [0, 2, 5] and end.tolist() == [1, 4, 6] and chars == 6


def test_chooser_equals_the_whole_table():
    """Pieces chosen range by range are those chosen on all boundaries, whatever the ranges."""
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 200)
        bounds = {a: rng.randint(1, 3) for a in sorted(rng.sample(range(1, n + 1), min(n, rng.randint(0, 40)))) if a < n}
        limit, overlap = rng.randint(1, 30), rng.randint(0, 12)
        chooser, got, lo, r = Chooser(limit, overlap), [], 0, 0
        while lo < n:
            hi = min(n, lo + rng.randint(0, 25))
            at = [a for a in bounds if lo <= a < hi]
            got += chooser.feed(r, hi - lo, hi - lo, 10, [0, 0, 0, 0, 1, 0, 0, 0], [a - lo for a in at], [bounds[a] for a in at])
            lo, r = hi, r + 1
        got += chooser.last()
        want = choose_pieces(n, list(bounds), list(bounds.values()), limit, overlap)
        if len(want) == 1:
            assert not got
        else:
            assert [(p, k, why) for *_, e, p, k, why in got if not e] == [(i, b - a, KINDS[w]) for i, (a, b, w) in enumerate(want)]


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"f{i}.txt": random_text(rng, n) for i, n in enumerate((2, 40, 700))} | {"empty.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    limits = spark.createDataFrame([("a", 10, 3)], LIMIT)
    want = sorted((r.document_id, r.piece, r.start_char, r.end_char, r.n_tokens, r.boundary) for r in split_oversized(docs(spark, [(n, "a", t) for n, t in texts.items()]), limits).collect())
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*texts, "f2.txt"]], "path string")
    for size in (97, 1 << 20):
        got = sorted((r.path.rsplit("/", 1)[-1], *list(r)[1:]) for r in split_files(paths, 10, 3, size).collect())
        assert got == want and want
