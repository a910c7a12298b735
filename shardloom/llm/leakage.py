"""Evaluation texts in a corpus: an Aho-Corasick automaton over normalised test items.

An item's patterns are all its sequences of `window` consecutive words, or all its words when it has fewer. They make
one automaton over word numbers, which reads each text once. Words are cut as in the module lexing; where a match is
found, the words' offsets in the original text are taken, so that spans refer to the text as it stands.

Automata are built in tasks and have a bounded size: items are cut into segments that overlap by window - 1 words, so
that each pattern is in one segment, and segments are dealt out to as many automata as their words need. Some thousands
of items make one automaton, and the corpus is read once; more items make more automata and as many readings. What a
text shares with several segments of an item is joined again afterwards.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.lexing import WORD, words
from shardloom.sources.scratch import materialize

WINDOW = 12
#: Words of items that one automaton takes: some 430 bytes a word when sent, 2,200 bytes a word in a worker.
AUTOMATON_WORDS = 50_000
#: Words of a segment of an item.
SEGMENT_WORDS = 5_000
#: No automaton above this size is sent to the workers; segments of fewer words are taken instead.
AUTOMATON_BYTES = 128 << 20


def _segments(window: int, segment: int):
    """item_id, words (of the segment, by blanks), n; each sequence of `window` words is in one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                step = max(1, segment - window + 1)
                out += [(item, " ".join(w[i : i + step + window - 1]), min(len(w) - i, step + window - 1)) for i in range(0, max(1, len(w) - window + 1), step) if w]
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["item_id", "words", "n"])

    return run


def _build(window: int):
    """Of the segments of a part, the pickled numbers of words and automaton of number sequences with the items they are of."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        known: dict[str, int] = {}
        patterns: dict[tuple[int, ...], set[int]] = {}
        for item, text in zip(rows["item_id"].tolist(), rows["words"]):
            w = [known.setdefault(x, len(known) + 1) for x in text.split(" ")]
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, of in patterns.items():
            automaton.add_word(p, (len(p), sorted(of)))
        automaton.make_automaton()
        packed = pickle.dumps((known, automaton))
        return pd.DataFrame({"part": [key[0]], "size": [len(packed)], "packed": [packed]})

    return run


def _scan(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = pickle.loads(packed.value)
        get = known.get
        names = ["doc_id", "text_hash", "item_id", "first", "last", "start_char", "end_char", "width"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5)
        for batch in batches:
            out = []
            for doc, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                runs: dict[int, list[list[int]]] = {}
                for last, (length, items) in automaton.iter(tuple([get(w, 0) for w in words(text)])):
                    for item in items:
                        held = runs.setdefault(item, [])
                        if held and last == held[-1][1] + 1 and length == held[-1][2]:
                            held[-1][1] = last  # the next sequence of words stands in the item, too
                        else:
                            held.append([last - length + 1, last, length])
                if runs:
                    place = [m.span() for m in WORD.finditer(text)]
                    out += [(doc, h, item, a, b, place[a][0], place[b][1], n) for item, held in runs.items() for a, b, n in held]
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, item_id, start_char, end_char, n_words: passages of items in documents, in characters of the original.

    documents: doc_id, text; items: item_id, text. A passage is a longest run of words in which every `window`
    consecutive words stand in the item; for an item with fewer words, as many words as it has. Null and empty texts,
    items without words and items without id give nothing. Equal documents and equal items count once; texts under one
    item_id are searched for as one item. Extra columns are ignored.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, start_char int, end_char int, n_words int"
    cut = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_segments(window, segment_words), "item_id long, words string, n long")
    segments = materialize(cut, "segments")
    total = segments.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    parts = math.ceil(total / automaton_words)
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).cast("int").alias("part")
    built = materialize(segments.select(part, "item_id", "words").groupBy("part").applyInPandas(_build(window), "part int, size long, packed binary"), "automata")
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    found = None
    for i, size in sorted(map(tuple, built.select("part", "size").collect())):  # a row an automaton
        if size > AUTOMATON_BYTES:
            raise ValueError(f"an automaton of {size} bytes; take fewer automaton_words")
        packed = spark.sparkContext.broadcast(built.where(F.col("part") == i).select("packed").first()[0])
        one = texts.mapInArrow(_scan(packed), "doc_id long, text_hash long, item_id long, first int, last int, start_char int, end_char int, width int")
        found = one if found is None else found.unionByName(one)
    # runs of several segments: a run goes on where the next sequence of words begins at most one word later
    of = ("doc_id", "text_hash", "item_id", "width")
    before = Window.partitionBy(*of).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("first") + F.col("width") - 1 > F.max("last").over(before) + 1, F.lit(True)).cast("int")
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy(*of).orderBy("first", "last")))
    joined = runs.groupBy(*of, "run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), (F.max("last") - F.min("first") + 1).cast("int").alias("n_words"))
    return joined.select("doc_id", "item_id", "start_char", "end_char", "n_words")
