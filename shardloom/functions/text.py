"""Tokens, overlapping chunks and page tokens, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token with the white space before it; white space is blank, tab, LF, CR and FF.
TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f]+"


def tokens(text: Column) -> Column:
    """The tokens of a text, each with the white space before it. Null, empty and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def bare(token: Column) -> Column:
    """A token without the white space before it."""
    return F.regexp_replace(token, r"^[ \t\n\r\f]+", "")


def chunk_count(n: Column, size: Column, overlap: Column) -> Column:
    """How many chunks n tokens make: none of none, one up to the size, and no chunk of a tail alone.

    Null for sizes and overlaps that chunks() doesn't take.
    """
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")
    return F.when((size > 0) & (overlap >= 0) & (overlap < size), count)


def chunks(found: Column, size: Column, overlap: Column) -> Column:
    """Arrays of tokens: chunks of `size` that share `overlap` tokens with the one before.

    Sizes that are null or not above 0, and overlaps that are null, negative or not below the size, give null.
    Pass `found` as a column, not as an expression: lambdas evaluate what they refer to for every element.
    """
    n = F.size(found)
    count = chunk_count(n, size, overlap)
    every = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(found, i * (size - overlap) + 1, size))
    return F.when(count > 0, every).when(count == 0, F.array().cast("array<array<string>>"))


def chunk_text(found: Column) -> Column:
    """The text of a chunk, with the white space inside it."""
    return bare(F.concat_ws("", found))


def urlsafe(text: Column) -> Column:
    """Url-safe base64 of the text's bytes, padded."""
    return F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_")


def from_urlsafe(code: Column) -> Column:
    """The text of a url-safe base64 code; null if it isn't one."""
    return F.try_to_binary(F.translate(code, "-_", "+/"), F.lit("base64")).cast("string")
