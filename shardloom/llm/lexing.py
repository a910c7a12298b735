"""Words and tokens of a text, in Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

#: A longest run of Unicode letters and digits; the underscore separates.
WORD = re.compile(r"[^\W_]+")
_JOIN = "\n"


def words(text: str | None) -> list[str]:
    """Lower-cased words. Words are cut before lower-casing, which can change the number of characters."""
    found = WORD.findall(text) if text else []
    return _JOIN.join(found).lower().split(_JOIN) if found else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 200_000) -> None:
        self._limit, self._known = limit, {}

    def __call__(self, found: Iterable[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._limit:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of `width` consecutive words, by order of place, from the words' hashes."""
    if len(h) < width:
        return h[:0]
    n = len(h) - width + 1
    out = h[:n]
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(i))
    return out
