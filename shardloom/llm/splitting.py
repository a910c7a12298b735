"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is cut into byte ranges. A worker sees a range with a halo (64 bytes before it, one after it) and finds the
tokens that start and end there, the number of code points, and the natural boundaries: token starts before which a
paragraph, a sentence or a line ends. The tables of a text's ranges are stitched by prefix sums of their counts; pieces
are chosen on the boundary tables alone, range after range, with a piece's worth of them in memory; a second look at the ranges that hold an edge
of a piece turns token numbers into offsets. No step after the scan holds a whole text. A text of one range takes the
same steps within its task, without a shuffle.

A piece has at most `limit` tokens, tokens being longest runs without blank, tab, LF, CR and FF. From a piece's first
token on, the last boundary of the strongest kind in the upper half of what the limit allows is taken, else the last
boundary of any kind that leaves more than the overlap, else the limit itself. The next piece starts `overlap` tokens
before the cut. A boundary is judged by what ends before a token, by the white space between, however long, and by the
token's first byte; where the white space begins before a range, the boundary table carries what the next range needs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALO = 64
RANGE_BYTES = 16_384
KINDS = ("limit", "line", "sentence", "paragraph", "end")

# White space between tokens, closing marks that may follow a sentence's end, and sentence ends.
_SPACE = np.isin(np.arange(256), [9, 10, 12, 13, 32])
_CLOSERS = ('"', "'", ")", "]", "»", "”", "’")
_STOPS = (".", "!", "?", "…", "。")
_NO_START = np.isin(np.arange(256), [*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)])


def _ends_with(buf: np.ndarray, at: np.ndarray, floor: np.ndarray, mark: str) -> np.ndarray:
    """Whether the bytes up to and with `at` end with mark, not reaching below floor."""
    raw = mark.encode()
    ok = at - len(raw) + 1 >= floor
    for i, byte in enumerate(reversed(raw)):
        ok &= buf[np.maximum(at - i, 0)] == byte
    return ok


def _breaks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running numbers of line ends and of form feeds."""
    newline = (buf == 10) | ((buf == 13) & np.r_[buf[1:] != 10, True])
    return np.r_[0, np.cumsum(newline)], np.r_[0, np.cumsum(buf == 12)]


def _stops(buf: np.ndarray, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a sentence ends with the byte `at`, apart from two closing marks."""
    at = at.copy()
    for _ in range(2):
        step = np.zeros(len(at), np.int64)
        for mark in _CLOSERS:
            step = np.where(_ends_with(buf, at, floor, mark), len(mark.encode()), step)
        at = at - step
    stop = np.zeros(len(at), bool)
    for mark in _STOPS:
        stop |= _ends_with(buf, at, floor, mark)
    return stop


def gap_of_range(raw: bytes, left: int, right: int) -> list[int]:
    """What a range tells about white space that crosses its edges.

    Whether its first token's white space begins before the range, the line ends and form feeds before that token (of
    the whole range if it is blank), and whether the token can't begin a sentence; whether the range isn't blank, whether
    a sentence ends with its last mark, and the line ends and form feeds after that.
    """
    buf = np.frombuffer(raw, np.uint8)
    end = len(buf) - right
    lines, feeds = _breaks(buf)
    marks = np.flatnonzero(~_SPACE[buf[left:end]]) + left
    if not len(marks):
        return [0, int(lines[end] - lines[left]), int(feeds[end] - feeds[left]), 0, 0, 0, 0, 0]
    first, last = int(marks[0]), int(marks[-1])
    crosses = left > 0 and (first > left or bool(_SPACE[buf[left - 1]]))
    stop = bool(_stops(buf, np.array([last]), np.zeros(1, np.int64))[0])
    return [int(crosses), int(lines[first] - lines[left]), int(feeds[first] - feeds[left]), int(_NO_START[buf[first]]), 1, int(stop), int(lines[end] - lines[last + 1]), int(feeds[end] - feeds[last + 1])]


def _first_kind(gap: list[int], stop: int, lines: int, feeds: int) -> tuple[int, int, int, int]:
    """Kind of the boundary before the first token of a range, 0 where the range sees it all itself, and what to carry on.

    Carried: whether a sentence ends with the last mark so far, and the line ends and form feeds after it.
    """
    crosses, head_lines, head_feeds, low, marked, ends, tail_lines, tail_feeds = gap
    many, fed = lines + head_lines, feeds + head_feeds
    first = (3 if many > 1 or fed else 2 if stop and not low else 1 if many else 0) if crosses else 0
    return (first, ends, tail_lines, tail_feeds) if marked else (first, stop, many, fed)


def scan_range(raw: bytes, left: int, right: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Tokens of a range that has `left` and `right` bytes of halo.

    Returns, relative to the range, the first code point of each token that starts there, the end of each token that
    ends there, the number of code points, and the kind of the boundary before each token that starts there.
    """
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    space = _SPACE[buf]
    before = np.r_[True, space[:-1]]
    after = np.r_[space[1:], True]
    if n and left == 0:
        before[0] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after)
    start = start[(start >= left) & (start < n - right)]
    end = end[(end >= left) & (end < n - right)]
    lead = np.cumsum((buf[left : n - right] & 0xC0) != 0x80)
    # kinds
    floor = np.zeros(len(start), np.int64)
    place = np.where(~space, np.arange(n), -1)
    last = np.maximum.accumulate(place)[np.maximum(start - 1, 0)] if n else start
    last = np.where(start > 0, last, -1)
    gap = np.maximum(last + 1, floor)
    lines, feeds = _breaks(buf)
    many = lines[start] - lines[gap]
    stop = _stops(buf, last, floor) & (last >= floor) & ~_NO_START[buf[start]]
    kind = np.where((many > 1) | (feeds[start] > feeds[gap]), 3, np.where(stop, 2, np.where(many > 0, 1, 0)))
    return lead[start - left] - 1, lead[end - left], int(lead[-1]) if len(lead) else 0, kind.astype(np.uint8)


def _cut(at: list[int], kind: list[int], s: int, limit: int, overlap: int) -> tuple[int, int]:
    """Where a piece from token s on ends, and the kind of that cut; boundaries stand before the tokens `at`."""
    most, least = s + limit, s + overlap + 1
    lo, hi = bisect_left(at, max(least, s + (limit + 1) // 2)), bisect_right(at, most)
    if lo < hi:
        best = max(kind[lo:hi])
        i = next(i for i in range(hi - 1, lo - 1, -1) if kind[i] == best)
        return at[i], best
    if bisect_left(at, least) < lo:
        return at[lo - 1], kind[lo - 1]
    return most, 0


def choose_pieces(tokens: int, at: list[int], kind: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, token after the last, kind of the cut) of each piece; boundaries stand before the tokens `at`."""
    overlap = min(max(overlap, 0), limit - 1)
    out, s = [], 0
    while s + limit < tokens:
        cut, why = _cut(at, kind, s, limit, overlap)
        out.append((s, cut, why))
        s = cut - overlap
    if tokens:
        out.append((s, tokens, 4))
    return out


_PIECE = "document_id string, index_name string, loaded_at timestamp, version long, piece int, start_char int, end_char int, n_tokens int, boundary string"


def _batches(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "timestamp": pa.timestamp("us", tz="UTC"), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts of one range."""
    schema = _arrow(_PIECE)
    for batch in batches:
        rows = []
        for doc, index, loaded, version, limit, overlap, raw in zip(*(c.to_pylist() for c in batch.columns)):
            start, end, _, kind = scan_range(raw, 0, 0)
            if len(start) <= limit:
                continue
            at = np.flatnonzero(kind)
            for i, (a, b, why) in enumerate(choose_pieces(len(start), at.tolist(), kind[at].tolist(), limit, overlap)):
                rows.append((doc, index, loaded, version, i, int(start[a]), int(end[b - 1]), b - a, KINDS[why]))
        yield _batches(schema, rows)


_TABLE = "document_id string, index_name string, loaded_at timestamp, version long, limit int, overlap int, r int, starts int, ends int, chars int, gap array<int>, at binary, kind binary"


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary tables of ranges."""
    schema = _arrow(_TABLE)
    for batch in batches:
        rows = []
        for *head, r, left, right, raw in zip(*(c.to_pylist() for c in batch.columns)):
            start, end, chars, kind = scan_range(raw, left, right)
            gap = gap_of_range(raw, left, right)
            if gap[0]:
                kind[:1] = 0
            at = np.flatnonzero(kind)
            rows.append((*head, r, len(start), len(end), chars, gap, at.astype("<i4").tobytes(), kind[at].tobytes()))
        yield _batches(schema, rows)


_EDGE = "document_id string, index_name string, loaded_at timestamp, version long, r int, base int, token int, is_end boolean, piece int, n_tokens int, boundary string"


class Chooser:
    """choose_pieces() over a text that comes range by range: what lies before the current piece is forgotten.

    A cut is known as soon as the token after the limit is, so that a piece's worth of boundaries and ranges is held.
    """

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap = limit, min(max(overlap, 0), limit - 1)
        self.s = self.pieces = self.begun = self.ended = self.chars = 0
        self.at: list[int] = []
        self.kind: list[int] = []
        self.ranges: list[tuple[int, int, int, int]] = []  # r, and starts, ends and code points before it
        self.gap = (0, 0, 0)

    def _place(self, token: int, ends: bool) -> tuple[int, int, int]:
        """Range, code points before it, and the token's number among those that start (end) there."""
        i = bisect_right(self.ranges, token, key=lambda x: x[2 if ends else 1]) - 1
        r, begun, ended, chars = self.ranges[i]
        return r, chars, token - (ended if ends else begun)

    def _piece(self, end: int, why: int) -> list[tuple]:
        out = [(*self._place(t, e), e, self.pieces, end - self.s, KINDS[why]) for t, e in ((self.s, False), (end - 1, True))]
        self.pieces += 1
        return out

    def feed(self, r: int, starts: int, ends: int, chars: int, gap: list[int], at: list[int], kind: list[int]) -> list[tuple]:
        """Edges of the pieces that a further range decides: r, code points before, token, is_end, piece, n_tokens, boundary."""
        first, *self.gap = _first_kind(gap, *self.gap)
        self.ranges.append((r, self.begun, self.ended, self.chars))
        self.at += [self.begun] * (first > 0) + [a + self.begun for a in at]
        self.kind += [first] * (first > 0) + kind
        self.begun, self.ended, self.chars = self.begun + starts, self.ended + ends, self.chars + chars
        out, passed = [], 0
        while self.s + self.limit < self.begun:
            cut, why = _cut(self.at, self.kind, self.s, self.limit, self.overlap)
            out += self._piece(cut, why)
            self.s = cut - self.overlap
        passed = bisect_left(self.at, self.s)
        del self.at[:passed], self.kind[:passed]
        passed = bisect_right(self.ranges, self.s, key=lambda x: x[1]) - 1
        del self.ranges[: max(0, passed)]
        return out

    def last(self) -> list[tuple]:
        """Edges of the last piece; none where the text is within the limit."""
        return self._piece(self.begun, 4) if self.pieces else []


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of pieces, each addressed by range and token within it, from boundary tables sorted by text and range."""
    schema = _arrow(_EDGE)
    now, at_range, chooser = None, -1, None
    for batch in batches:
        rows = []
        for *key, limit, overlap, r, starts, ends, chars, gap, at, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if chooser:
                    rows += [(*now, *e) for e in chooser.last()]
                now, at_range, chooser = key, -1, Chooser(limit, overlap)
            if r != at_range:  # copies of a row give equal ranges
                at_range = r
                rows += [(*key, *e) for e in chooser.feed(r, starts, ends, chars, gap, np.frombuffer(at, "<i4").tolist(), np.frombuffer(kind, np.uint8).tolist())]
        yield _batches(schema, rows)
    if chooser:
        yield _batches(schema, [(*now, *e) for e in chooser.last()])


_FOUND = "document_id string, index_name string, loaded_at timestamp, version long, piece int, n_tokens int, boundary string, start_char int, end_char int"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets of the edges that a range holds."""
    schema = _arrow(_FOUND)
    for batch in batches:
        rows = []
        for doc, index, loaded, version, left, right, raw, edges in zip(*(c.to_pylist() for c in batch.columns)):
            start, end, _, _ = scan_range(raw, left, right)
            for e in edges:
                place = e["base"] + int((end if e["is_end"] else start)[e["token"]])
                rows.append((doc, index, loaded, version, e["piece"], e["n_tokens"], e["boundary"], *((None, place) if e["is_end"] else (place, None))))
        yield _batches(schema, rows)


def _pieces_of_ranges(ranges: DataFrame) -> DataFrame:
    """Pieces of texts that come as ranges: document_id, index_name, loaded_at, version, limit, overlap, r, left, right, part.

    The ranges of a text pass a task in order, with the state of a piece; their bytes don't.
    """
    key = ("document_id", "index_name", "loaded_at", "version")
    tables = ranges.mapInArrow(_boundaries, _TABLE).repartition(*key).sortWithinPartitions(*key, "limit", "overlap", "r")
    edges = tables.mapInArrow(_stitch, _EDGE)
    by_range = edges.groupBy(*key, "r").agg(F.collect_list(F.struct("base", "token", "is_end", "piece", "n_tokens", "boundary")).alias("edges"))  # no more than tokens of a range
    again = ranges.withColumnsRenamed({c: f"_{c}" for c in (*key, "r")})
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in (*key, "r")]
    held = by_range.join(again, same).select(*key, "left", "right", "part", "edges").mapInArrow(_locate, _FOUND)
    return held.groupBy(*key, "piece", "n_tokens", "boundary").agg(F.max("start_char").alias("start_char"), F.max("end_char").alias("end_char"))


def split_files(files: DataFrame, limit: int, overlap: int, range_bytes: int = 64 * RANGE_BYTES) -> DataFrame:
    """Pieces of text files (path) in UTF-8 with more than `limit` tokens: path, piece, start_char, end_char, n_tokens, boundary.

    Workers read byte ranges of the files by offset, so that no file is ever loaded as a whole. Repeated paths count
    once; files within the limit, empty ones too, give no pieces. Paths are local, or URIs that pyarrow's file systems know.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([_store(p)[0].get_file_info(_store(p)[1]).size or 0 for p in paths], pa.int64())], ["path", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("r", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("part", pa.binary())])
        for batch in batches:
            for path, size, r in zip(*(c.to_pylist() for c in batch.columns)):
                begin = r * range_bytes
                left, right = min(begin, HALO), int(begin + range_bytes < size)
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    yield _batches(schema, [(path, r, left, right, f.read_at(min(left + range_bytes + right, size - begin + left), begin - left))])

    known = files.select("path").where("path IS NOT NULL").distinct().mapInArrow(sizes, "path string, size long").where("size > 0")
    each = known.select("path", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / range_bytes).cast("int"))).alias("r")).repartition("path", "r")
    parts = each.mapInArrow(read, "path string, r int, left int, right int, part binary")
    null = lambda kind: F.lit(None).cast(kind)
    ranges = parts.select(F.col("path").alias("document_id"), null("string").alias("index_name"), null("timestamp").alias("loaded_at"), null("long").alias("version"), F.lit(limit).alias("limit"), F.lit(overlap).alias("overlap"), "r", "left", "right", "part")
    return _pieces_of_ranges(ranges).select(F.col("document_id").alias("path"), "piece", "start_char", "end_char", "n_tokens", "boundary")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def split_oversized(documents: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the texts that have more tokens than their index allows.

    documents: document_id, index_name, content, loaded_at; limits: index_name, max_parent_chunk_size,
    parent_chunk_overlap_size, one row an index. Result: document_id, index_name, piece (from 0), start_char, end_char,
    n_tokens, boundary (paragraph, sentence, line, limit or end, of the piece's end).

    No pieces come of null, empty and blank texts, of texts within the limit, and where the limit is null or not above
    0 or the index is unknown. A null or negative overlap counts as 0, one of the limit or more as limit - 1. Rows that
    repeat a document_id count once, by the latest loaded_at; without a document_id each text counts, equal rows once. Extra columns are ignored, whatever their names.
    """
    sizes = limits.where("max_parent_chunk_size > 0").select("index_name", F.col("max_parent_chunk_size").alias("limit"), F.coalesce("parent_chunk_overlap_size", F.lit(0)).alias("overlap"))
    version = F.xxhash64("content")
    own = documents.select("document_id", "index_name", "loaded_at", version.alias("version"), F.col("content").cast("binary").alias("raw"))
    size = F.octet_length("raw")
    # more than `limit` tokens take at least 2 * limit + 1 bytes
    texts = own.join(sizes, "index_name").where(size >= 2 * F.col("limit") + 1)
    head = ("document_id", "index_name", "loaded_at", "version", "limit", "overlap")
    short = texts.where(size <= range_bytes).select(*head, "raw").mapInArrow(_whole, _PIECE)

    long = texts.where(size > range_bytes).select("*", F.explode(F.sequence(F.lit(0), ((size - 1) / range_bytes).cast("int"))).alias("r"))
    begin = F.col("r") * range_bytes
    left = F.least(begin, F.lit(HALO))
    right = F.when(begin + range_bytes < size, 1).otherwise(0)
    ranges = long.select(*head, "r", left.alias("left"), right.alias("right"), F.substring("raw", begin - left + 1, left + range_bytes + right).alias("part"))
    far = _pieces_of_ranges(ranges.repartition(F.col("document_id"), F.col("r")))  # the ranges of one text go to many tasks

    pieces = short.unionByName(far)
    latest = documents.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max(F.struct("loaded_at", version.alias("version"))).alias("last"))
    is_latest = F.col("last.loaded_at").eqNullSafe(F.col("loaded_at")) & (F.col("last.version") == F.col("version"))
    kept = pieces.join(latest.select(F.col("document_id").alias("_id"), "last"), F.col("document_id") == F.col("_id"), "left").where(F.col("document_id").isNull() | is_latest)
    # rows without an id are records of their own
    own_row = F.when(F.col("document_id").isNull(), F.struct("index_name", "loaded_at", "version"))
    kept = kept.withColumn("own", own_row).dropDuplicates(["document_id", "own", "piece"])
    return kept.select("document_id", "index_name", "piece", "start_char", "end_char", "n_tokens", "boundary")
