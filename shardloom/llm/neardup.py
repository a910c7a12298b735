"""Near-duplicate records: a byte-position inverted index with count filtering.

A record is the set of its sequences of `width` consecutive words. It is laid out as a sparse byte string: the hash of
each sequence names a position and the byte that stands there; a position with its byte is a cell. Cells are dealt out
to buckets by another part of the hash, so that positions, buckets and tasks grow with the collection.

Guarantee. Let A be a record of |A| sequences of which m(A) fell on a cell of another one. A partner at similarity t or
more shares at least t * |A| sequences with it, hence at least need(A) = ceil(t * |A|) - m(A) cells. Order all cells from
rare to frequent, by the number of records that have them. If two sets share k cells, then their first
|cells| - k + c cells share at least min(c, k). So a pair at the threshold shares at least min(`shared`, need(A), need(B))
cells among the first |cells| - need + `shared` cells of each record: only these are posted. For two given records the
same holds with must(A, B) = ceil(t / (1 + t) * (|A| + |B|)) - min(m(A), m(B)), which is at least need, in the place of need,
so that fewer cells count. Pairs are tallied over all lists, and those that reach the minimum are retained. Cells that no other record has come first in the order and are
never posted; records of which too many cells are their own have nothing posted at all. Retained pairs are verified on
the 64-bit sequences themselves.

Nothing is capped. Buckets with more cells than `bucket_cells`, as where a third of all records have a cell in common,
are counted in shares whose counts are summed, and tallied as pairs of shares. Records with equal sets form a class
and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.lexing import WordHashes, mix, shingle_hashes, words
from shardloom.sources.scratch import discard, materialize

#: Records whose cells make up a bucket, on the average.
BUCKET_RECORDS = 10_000
#: Cells of a bucket beyond which it is split into shares.
BUCKET_CELLS = 8_000_000
#: Matches that two records must have among their first cells; more mean longer lists and fewer pairs to verify.
SHARED = 5
#: So many records that are to be read again are looked up in a broadcast table of 8 bytes each; more are joined.
AGAIN_ROWS = 1_000_000
#: Records whose words a worker holds at once.
SLICE_ROWS = 500
_PRINT = "document_id string, loaded_at timestamp, usable boolean, cid long, bucket int, cells int, payload binary"
_PACKED = "bucket int, cells int, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join((np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], "<i8").tobytes(), *(a.tobytes() for a in arrays)))


def _unpack(raw: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 2 * k)
    at, out = head.nbytes, []
    for n, kind in zip(head[1 : k + 1].tolist(), head[k + 1 :].tolist()):
        out.append(np.frombuffer(raw, chr(kind), n, at))
        at += out[-1].nbytes
    return out


def _share(cid: np.ndarray, shares: int) -> np.ndarray:
    return ((cid.view(np.uint64) >> np.uint64(7)) % np.uint64(shares)).astype(np.int64)


def _spread(held: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of `held[i]` items from `start[i]` on, for all i."""
    ends = np.cumsum(held)
    return np.repeat(start - (ends - held), held) + np.arange(ends[-1] if len(ends) else 0)


def _sequences(title: str | None, content: str | None, least_words: int) -> list[str] | None:
    """The words of a record; None where its content has too few."""
    w = words(content)
    return words(title) + w if len(w) >= least_words else None


def _sets(found: list[list[str]], hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences and their owners, by owner, and of each owner an order-free hash of its set."""
    n = np.array([len(w) for w in found])
    s = shingle_hashes(hashes([x for w in found for x in w]), width)
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[: len(s)] == owner[len(owner) - len(s) :]  # first and last word are of one record
    s, owner = s[inside], owner[: len(s)][inside]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[fresh], owner[fresh]
    total = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, owner, mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
        return s, owner, mix(total + np.bincount(owner, minlength=len(n)).astype(np.uint64)).view(np.int64)


def _fingerprint(width: int, least_words: int, buckets: int):
    """Of each record its class; of each slice, by bucket, the cells of its classes: cid, size, merged, cells here."""

    def rows(columns: dict) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PRINT.split(", ")]
        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            found = [_sequences(t, c, least_words) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            usable = np.array([w is not None for w in found], bool)
            s, owner, cid = _sets([w or [] for w in found], hashes, width)
            yield rows({"document_id": batch.column(0), "loaded_at": batch.column(3).cast(pa.timestamp("us", "UTC")), "usable": usable, "cid": cid})
            # copies inside the slice are posted once
            first = np.zeros(len(cid), bool)
            first[np.unique(cid, return_index=True)[1]] = True
            keep = (first & usable)[owner]
            s, owner = s[keep], owner[keep]
            size = np.bincount(owner, minlength=len(cid)).astype(np.int32)
            bucket = (mix(s) % np.uint64(buckets)).astype(np.int64)
            cell = (s >> np.uint64(32)).astype(np.uint32)  # 24 bits of position, 8 bits of byte, in the space of the bucket
            order = np.lexsort((cell, owner, bucket))
            bucket, owner, cell = bucket[order], owner[order], cell[order]
            fresh = np.ones(len(cell), bool)
            fresh[1:] = (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
            merged = np.bincount(owner[~fresh], minlength=len(cid)).astype(np.int32)
            bucket, owner, cell = bucket[fresh], owner[fresh], cell[fresh]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], int)
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                at = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
                who = owner[a:b][at]
                out.append((int(bucket[a]), b - a, _pack(cid[who], size[who], merged[who], np.diff(np.r_[at, b - a]).astype(np.int32), cell[a:b])))
            if out:
                yield rows(dict(zip(("bucket", "cells", "payload"), map(list, zip(*out)))))

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of buckets of several shares, by share: the last array of a payload holds items of the records, as the last but one counts."""
    for batch in batches:
        out = []
        for bucket, shares, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if shares == 1:
                out.append((bucket, 0, raw))
                continue
            *of, held, items = _unpack(raw)
            start = np.cumsum(held) - held
            mine = _share(of[0], shares)
            for i in np.unique(mine):
                at = mine == i
                out.append((bucket, int(i), _pack(*(x[at] for x in of), held[at], items[_spread(held[at].astype(np.int64), start[at])])))
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "share", "payload"])


def _gather(payloads) -> tuple[np.ndarray, ...]:
    """cid, size, merged, held and cells of the records of a share; copies from other slices are left out."""
    parts = [_unpack(p) for p in payloads]
    cid, size, merged, held, cell = (np.concatenate([p[i] for p in parts]) for i in range(5))
    start = np.cumsum(held.astype(np.int64)) - held
    cid, at = np.unique(cid, return_index=True)
    held = held[at].astype(np.int64)
    return cid, size[at], merged[at], held, cell[_spread(held, start[at])]


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The cells of a share, with the number of its records that have them."""
    cell, n = np.unique(_gather(rows["payload"])[4], return_counts=True)
    return pd.DataFrame({"bucket": [key[0]], "payload": [_pack(cell, n.astype(np.int64))]})


def _sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The cells of a bucket that more than one record has, with their number of records."""
    parts = [_unpack(p) for p in rows["payload"]]
    cell, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    return pd.DataFrame({"bucket": [key[0]], "payload": [_pack(cell[n > 1], n[n > 1])]})


def _shared_cells(groups: int):
    """Of a share, by group of records, the cells that other records have, too: cid, size, merged, cells here, shared ones, cells and ranks.

    The rank is by the number of records, in eighths of a power of two; any order that is the same for all records will do.
    """

    def run(key: tuple, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"bucket": [], "cells": [], "grp": [], "payload": []}).astype({"bucket": "int32", "cells": "int32", "grp": "int32", "payload": "object"})
        if not len(rows):
            return none
        cid, size, merged, held, cell = _gather(rows["payload"])
        if len(counts):  # of a bucket of several shares
            known, n = _unpack(counts["payload"].iloc[0])
            at = np.minimum(np.searchsorted(known, cell), max(len(known) - 1, 0))
            n = np.where(known[at] == cell, n[at], 1) if len(known) else np.ones(len(cell), np.int64)
        else:
            _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
            n = n[at]
        owner = np.repeat(np.arange(len(cid)), held)
        several = n > 1
        shared = np.bincount(owner[several], minlength=len(cid))
        cell, n = cell[several], n[several]
        start = np.cumsum(shared) - shared
        grp = _share(cid, groups)
        out = []
        for g in np.unique(grp):
            at = np.flatnonzero(grp == g)
            of = _spread(shared[at], start[at])
            out.append((key[0], len(of), int(g), _pack(cid[at], size[at], merged[at], held[at].astype(np.int32), shared[at].astype(np.int32), cell[of], np.minimum(255, np.log2(n[of]) * 8).astype(np.uint8))))
        return pd.DataFrame(out, columns=["bucket", "cells", "grp", "payload"])

    return run


def _prefixes(similarity: float, shared: int):
    """Of a group of records, by bucket, the postings: cid, size, merged, number, and cells under their places in the order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(p) for p in rows["payload"]]
        cid = np.concatenate([p[0] for p in parts])
        known, first, who = np.unique(cid, return_index=True, return_inverse=True)
        size, merged = (np.concatenate([p[i] for p in parts])[first].astype(np.int64) for i in (1, 2))
        here, there = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (3, 4))
        owner = np.repeat(who, there)
        bucket = np.repeat(np.repeat(rows["bucket"].to_numpy(), [len(p[0]) for p in parts]), there)
        cell, n = (np.concatenate([p[i] for p in parts]) for i in (5, 6))
        held = np.bincount(who, here, len(known)).astype(np.int64)
        own = held - np.bincount(who, there, len(known)).astype(np.int64)  # cells of no other record come first
        need = np.maximum(1, np.ceil(similarity * size - 1e-9).astype(np.int64) - merged)
        least = np.minimum(shared, need)
        order = np.lexsort((cell, bucket, n, owner))
        owner, bucket, cell = owner[order], bucket[order], cell[order]
        begin = np.searchsorted(owner, np.arange(len(known)))
        place = np.arange(len(owner)) - begin[owner] + own[owner]
        posted = (place < (held - need + least)[owner]) & (held - own >= need)[owner]
        owner, bucket, cell = owner[posted], bucket[posted], place[posted].astype(np.uint64) << np.uint64(32) | cell[posted]
        order = np.lexsort((owner, bucket))
        owner, bucket, cell = owner[order], bucket[order], cell[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], int)
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            at = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
            w = owner[a:b][at]
            out.append((int(bucket[a]), b - a, _pack(known[w], size[w].astype(np.int32), (size - held)[w].astype(np.int32), np.diff(np.r_[at, b - a]).astype(np.int32), cell[a:b])))
        return pd.DataFrame(out, columns=["bucket", "cells", "payload"]).astype({"bucket": "int32", "cells": "int32"})

    return run


def _tally(similarity: float, shared: int, step: int = 2_000_000):
    """Of a share or a pair of shares of a bucket, how many cells its pairs of records have in common: a < b, n, least.

    Cells count only up to the places that the sizes of the two records leave: |cells| - must + `shared`.

    Records are walked in order, each with the later partners in all its lists, in pieces of some `step` matches, so that
    memory is bounded; what a pair shares in this bucket is summed before it is passed on.
    """

    portion = similarity / (1 + similarity)

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        cid, size, merged, held, cell = _gather(rows["payload"])
        size, merged = size.astype(np.int64), merged.astype(np.int64)
        place, cell = (cell >> np.uint64(32)).astype(np.int64), cell.astype(np.uint32)
        side = rows["share"].nunique() > 1
        shares = _share(cid, int(rows["shares"].iloc[0])) if side else None
        owner = np.repeat(np.arange(len(cid)), held)
        order = np.lexsort((owner, cell))
        t, o, place = cell[order], owner[order], place[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.array([], int)
        sizes = np.diff(np.r_[starts, len(t)])
        later = np.repeat(starts + sizes, sizes) - np.arange(len(t)) - 1
        entry = np.argsort(o, kind="stable")
        entry = entry[later[entry] > 0]
        first = np.flatnonzero(np.r_[True, o[entry][1:] != o[entry][:-1]]) if len(entry) else np.array([], int)
        cuts, done, lo = np.r_[first, len(entry)], np.r_[0, np.cumsum(later[entry])], 0
        out, waiting = [], 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(done[cuts], done[cuts[lo]] + step, "right")) - 1)
            e = entry[cuts[lo] : cuts[hi]]
            m = later[e]
            left = np.repeat(e, m)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            x, y = o[left], o[right]
            both = size[x] + size[y]
            must = np.maximum(1, np.ceil(portion * both - 1e-9).astype(np.int64) - np.minimum(merged[x], merged[y]))
            spare = np.minimum(shared, must) - must  # beyond these places a shared cell says nothing about the pair
            fits = (place[left] < size[x] - merged[x] + spare) & (place[right] < size[y] - merged[y] + spare)
            fits &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
            if side:
                fits &= shares[x] != shares[y]
            codes, n = np.unique(x[fits].astype(np.int64) * len(cid) + y[fits], return_counts=True)
            a, b = codes // len(cid), codes % len(cid)
            out.append(pd.DataFrame({"a": cid[a], "b": cid[b], "n": n.astype(np.int32), "least": np.minimum(shared, np.maximum(1, np.ceil(portion * (size[a] + size[b]) - 1e-9).astype(np.int64) - np.minimum(merged[a], merged[b]))).astype(np.int32)}))
            waiting += len(codes)
            if waiting > step:
                yield pd.concat(out)
                out, waiting = [], 0
            lo = hi
        if out:
            yield pd.concat(out)

    return run


def _again(width: int, least_words: int):
    """cid and the 64-bit sequences of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            found = [_sequences(t, c, least_words) or [] for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            s, owner, cid = _sets(found, hashes, width)
            ends = np.cumsum(np.bincount(owner, minlength=len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(s.view(np.int64)))], ["cid", "sequences"])

    return run


class NearDuplicates:
    """Near-duplicate records of a table (document_id, title, content, loaded_at).

    members: document_id, cid - one row a usable record, cid its class of equal sets.
    class_pairs: a, b (a < b), similarity - all pairs of classes at or above the threshold.

    Rows that repeat a document_id count once, by the latest loaded_at. Null title or content is empty. Records with
    fewer than `least_words` words of content take no part, so empty and blank texts don't. An empty table gives empty
    results. Columns other than the four are ignored, whatever their names.
    """

    def __init__(self, documents: DataFrame, similarity: float = 0.5, width: int = 3, least_words: int = 20, shared: int = SHARED, bucket_records: int = BUCKET_RECORDS, bucket_cells: int = BUCKET_CELLS) -> None:
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        buckets = max(1, math.ceil(documents.count() / bucket_records))
        texts = documents.select("document_id", "title", "content", "loaded_at")
        prints = materialize(texts.mapInArrow(_fingerprint(width, least_words, buckets), _PRINT), "prints")
        latest = F.max(F.struct("loaded_at", "usable", "cid")).alias("last")
        self.members = materialize(prints.where("payload IS NULL").groupBy("document_id").agg(latest).where("last.usable").select("document_id", F.col("last.cid").alias("cid")), "members")

        def shares(packed: DataFrame) -> DataFrame:
            """bucket, share, shares, payload: buckets of too many cells in several shares of their records."""
            long = packed.groupBy("bucket").agg(F.sum("cells").alias("n")).where(F.col("n") > bucket_cells)
            long = materialize(long.select("bucket", F.ceil(F.col("n") / bucket_cells).cast("int").alias("shares")), "long")
            known = packed.join(long, "bucket", "left").select("bucket", F.coalesce("shares", F.lit(1)).alias("shares"), "payload")
            return known.mapInArrow(_split, "bucket int, share int, payload binary").join(long, "bucket", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))

        cells = shares(prints.where("payload IS NOT NULL").select("bucket", "cells", "payload"))
        counts = cells.where("shares > 1").groupBy("bucket", "share").applyInPandas(_count, "bucket int, payload binary").groupBy("bucket").applyInPandas(_sum, "bucket int, payload binary")
        counts = counts.join(cells.where("shares > 1").select("bucket", "share").distinct(), "bucket").select(F.col("bucket").alias("of"), F.col("share").alias("part"), F.col("payload").alias("counted"))
        renamed = counts.select("of", "part", F.col("counted").alias("payload"))
        common = cells.groupBy("bucket", "share").cogroup(renamed.groupBy("of", "part")).applyInPandas(_shared_cells(buckets), "bucket int, cells int, grp int, payload binary")
        posted = materialize(common.groupBy("grp").applyInPandas(_prefixes(similarity, shared), _PACKED), "posted")
        discard(prints)

        lists = shares(posted)
        every, mine = F.sequence(F.lit(0), F.col("shares") - 1), F.col("share")
        meets = F.transform(every, lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))
        met = lists.select("bucket", "share", "shares", "payload", F.explode(meets).alias("m")).select("bucket", "m.x", "m.y", "share", "shares", "payload")
        tallied = met.groupBy("bucket", "x", "y").applyInPandas(_tally(similarity, shared), "a long, b long, n int, least int")
        retained = tallied.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where(F.col("n") >= F.col("least")).select("a", "b")
        retained = materialize(retained, "retained")

        # one record of each class that is in a retained pair is read again, and its sequences compared
        ends = retained.select(F.col("a").alias("cid")).unionByName(retained.select(F.col("b").alias("cid"))).distinct()
        one = self.members.groupBy("cid").agg(F.min("document_id").alias("document_id")).join(ends, "cid", "left_semi").select(F.xxhash64("document_id").alias("h"))
        one = materialize(one.distinct(), "again")
        one = F.broadcast(one) if one.count() <= AGAIN_ROWS else one
        read = texts.withColumn("h", F.xxhash64("document_id")).join(one, "h", "left_semi").select("document_id", "title", "content")
        whole = read.mapInArrow(_again(width, least_words), "cid long, sequences array<long>").repartition("cid").dropDuplicates(["cid"])
        left, right = (whole.select(F.col("cid").alias(c), F.col("sequences").alias(f"s{c}")) for c in ("a", "b"))
        both = retained.join(left, "a").join(right, "b")
        n = F.size(F.array_intersect("sa", "sb"))
        reached = (n / (F.size("sa") + F.size("sb") - n)).alias("similarity")
        self.class_pairs = materialize(both.select("a", "b", reached).where(F.col("similarity") >= similarity - 1e-12), "pairs")

    def pairs(self) -> DataFrame:
        """document_id_a, document_id_b: all pairs of different records, the smaller id in byte order first.

        Records of one class are pairs too; this listing is as large as the cases are. groups() is the compact form.
        """
        m = self.members
        left, right = (m.select(F.col("document_id").alias(f"d{i}"), F.col("cid").alias(f"c{i}")) for i in (1, 2))
        equal = left.join(right, (F.col("c1") == F.col("c2")) & (F.col("d1") < F.col("d2")))
        similar = left.join(self.class_pairs, F.col("c1") == F.col("a")).join(right, F.col("c2") == F.col("b"))
        both = equal.select("d1", "d2").unionByName(similar.select("d1", "d2"))
        return both.select(F.least("d1", "d2").alias("document_id_a"), F.greatest("d1", "d2").alias("document_id_b"))

    def groups(self) -> DataFrame:
        """document_id, group_id, links: one row a usable record.

        group_id is the smallest document_id that links of similar pairs reach; links counts the similar partners.
        """
        size = self.members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("least"))
        label = components(self.class_pairs)
        out = self.class_pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(self.class_pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
        partners = out.join(size.select(F.col("cid").alias("other"), "copies"), "other").groupBy("cid").agg(F.sum("copies").alias("partners"))
        known = size.join(label, "cid", "left").select("cid", "copies", "least", F.coalesce("label", "cid").alias("label"))
        named = known.join(known.groupBy("label").agg(F.min("least").alias("group_id")), "label").join(partners, "cid", "left")
        links = (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links")
        return self.members.join(named, "cid").select("document_id", "group_id", links)


def components(edges: DataFrame) -> DataFrame:
    """cid, label: the smallest id of each connected component of edges (a, b).

    Each round lets a node take the smallest label around it and then the label of its label; labels are tables in the
    shared folder, only the number of changes reaches the driver. Isolated nodes have no row.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        step = labels.join(near, "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("cid").alias("label"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "label", "left").select("cid", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("cid", "label")
        if new.where("old <> label").isEmpty():
            return labels
