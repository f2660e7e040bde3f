"""Controlled noise: character shuffle of one topic's texts (ST9, PF5).

The shuffle is a sort of the text's code points by 32 bits of md5(seed:key:block), four code points to a
digest, then by position, so it is reproducible and independent of partitioning; each row is handled on
its own (no shuffle), by numpy inside the tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_DIGEST, DIGITS = 4, 8  # 32 bits for each code point


def shuffle_chars(text: Column, key: Column, seed: str = "noise") -> Column:
    """A permutation of the code points of ``text`` ('' stays '')."""

    @F.pandas_udf("string")
    def shuffled(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        def one(t, prefix):
            if not isinstance(t, str) or not t:
                return t
            n, head = len(t), hashlib.md5(prefix.encode())
            digests = []
            for j in range(-(-n // PER_DIGEST)):
                h = head.copy()
                h.update(b"%d" % j)
                digests.append(h.digest())
            order = np.argsort(np.frombuffer(b"".join(digests), ">u4")[:n], kind="stable")
            return np.frombuffer(t.encode("utf-32-le"), "<u4")[order].tobytes().decode("utf-32-le")

        return pd.Series([one(t, p) for t, p in zip(texts, prefixes)], dtype=object)

    return shuffled(text, F.concat(F.concat_ws(":", F.lit(seed), key.cast("string")), F.lit(":")))


def inject_noise(df: DataFrame, topic: str | None = "Technology", seed: str = "noise", key_col: str = "doc_id") -> DataFrame:
    """Rows whose labels contain ``topic`` get their text shuffled; others are untouched (no topic: all)."""
    hit = F.lit(False) if topic is None else F.array_contains("labels", topic)
    out = df.withColumn("noised", hit)
    shuffled = shuffle_chars(F.when(F.col("noised"), F.col("text")), F.col(key_col), seed)  # other texts are not sent to Python
    return out.withColumn("text", F.when(F.col("noised"), shuffled).otherwise(F.col("text")))
