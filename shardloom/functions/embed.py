"""Embedding texts. The built-in embedder is signed feature hashing; models plug in as Arrow functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

DIM = 256
#: What texts begin with, by their role; fixed values of the models that this engine is used with.
DOCUMENT, QUERY = "search_document: ", "search_query: "
_TOKEN = re.compile(r"[^ \t\n\r\f]+")


class _Hashes(dict):
    """The first 32 bits of the MD5 of a token in lower case."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = int.from_bytes(hashlib.md5(token.lower().encode("utf-8", "surrogatepass")).digest()[:4], "big")
        return found


def _weights(texts: list[str | None], dim: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and weight of the sparse vectors of the texts, by text and bucket."""
    found = [_TOKEN.findall(t) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    h = np.array([known[t] for f in found for t in f], np.int64)
    code, at = np.unique(owner * dim + h % dim, return_inverse=True)
    w = np.bincount(at, np.where(h // dim % 2 == 0, 1.0, -1.0), len(code)) if len(code) else np.zeros(0)
    code, w = code[w != 0], w[w != 0]
    norm = np.sqrt(np.bincount(code // dim, w * w, len(found)))
    return code // dim, (code % dim).astype(np.int32), w / norm[code // dim]


def features(df: DataFrame, text: Column, *keys: str, dim: int = DIM) -> DataFrame:
    """keys, bucket, weight: the sparse hashed vector of each text, of length 1.

    A token's first 32 bits of MD5 name its bucket and sign. Buckets that cancel out are left out, so that a text
    without tokens, or whose tokens all cancel, has no rows. A text's vector needs no other row: nothing is shuffled.
    """
    rows = df.select(*keys, text.cast("string").alias("_text"))
    schema = rows.select(*keys).schema.add("bucket", IntegerType()).add("weight", DoubleType())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            owner, bucket, weight = _weights(batch.column(batch.num_columns - 1).to_pylist(), dim, known)
            kept = [c.take(pa.array(owner)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bucket), pa.array(weight)], names)

    return rows.mapInArrow(run, schema)


def hash_embedder(dim: int = DIM, prefix: str = DOCUMENT) -> Callable[[Column], Column]:
    """A column function that gives the dense hashed vector of a text, with its role before it."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Hashes()
        for texts in batches:
            owner, bucket, weight = _weights([prefix + (t or "") for t in texts], dim, known)
            dense = np.zeros((len(texts), dim), np.float32)
            dense[owner, bucket] = weight
            yield pd.Series(list(dense))

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = DOCUMENT) -> Callable[[Column], Column]:
    """A column function for a dense model. `load` runs once a worker and returns texts -> vectors; queries take QUERY as prefix."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model([prefix + (t or "") for t in texts]))

    return embed
