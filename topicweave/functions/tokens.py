"""Token pieces and fixed-length chunking as native Spark expressions.

The default piece pattern is lossless: concatenating the pieces of a text gives the text
back, so a chunk's text is the join of its pieces. A real sub-word vocabulary can replace
it through ``piece_ids`` in ``operators.sequences``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default piece pattern (leading whitespace attaches to the next word;
# trailing whitespace is a piece of its own). Identical in Java regex and RE2.
TOKEN_PATTERN = r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+"


def token_pieces(text: Column) -> Column:
    """array<string> of pieces over the whole text ([] for empty or null text)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    return F.size(token_pieces(text))


def chunk_starts(n_pieces: Column, chunk_len: int) -> Column:
    """0-based start offsets of the chunks; guards ``sequence(0, -1)`` which Spark fills backwards."""
    return F.when(
        n_pieces > 0, F.sequence(F.lit(0), n_pieces - 1, F.lit(chunk_len))
    ).otherwise(F.array().cast("array<int>"))


def chunk_arrays(pieces: Column, chunk_len: int) -> Column:
    """array<array<string>>: consecutive slices of ``chunk_len`` pieces, the last one short."""
    return F.transform(chunk_starts(F.size(pieces), chunk_len), lambda i: F.slice(pieces, i + 1, chunk_len))


def pad_right(arr: Column, length: int, pad_value) -> Column:
    """Truncate to ``length`` then pad with ``pad_value`` up to ``length``."""
    head = F.slice(arr, 1, length)
    return F.concat(head, F.array_repeat(F.lit(pad_value), F.lit(length) - F.size(head)))
