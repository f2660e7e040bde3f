"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null counts as empty) beside the SHA-256 of
the tokenizer (vocabulary file, library version, options). Texts are joined to the cache by key;
of the keys it lacks, one row each is encoded, and the new counts are appended to the cache, so a
text that comes again, in this table or in a later one, is never encoded twice.

The tokenizer is byte-level BPE from a ``.json`` file, read by the ``tokenizers`` library. A blank
between two non-blank characters always starts a new piece of its split rule, so a text without
other adjoining blanks is the sum of its blank-led words, and each worker keeps the counts of the
words it has met (at most ``WORDS`` of them; beyond that the store is emptied). Every other text,
and every text that holds one of the tokenizer's special strings, is encoded whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and ids give one row
each; an empty table gives no rows and leaves the cache as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.tables import shared_path, written
from topicweave.llm.textbytes import worker_state

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
WORDS = 300_000


def tokenizer_digest(tokenizer_json: bytes) -> str:
    """The version key: vocabulary and rules, library version, and that no special tokens are added."""
    return hashlib.sha256(tokenizer_json + f"|tokenizers {version('tokenizers')}|add_special_tokens=False".encode()).hexdigest()


class WordCounter:
    """Counts tokens of texts, remembering the counts of words."""

    def __init__(self, tokenizer_json: bytes, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.known = words, {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """The text's blank-led words; None where the cut rule does not hold."""
        if any(s in text for s in self.special):
            return None
        parts = text.split(" ")
        out = [" " + p for p in parts]
        out[0] = parts[0]
        # a part that is empty, or begins or ends with white space, adjoins another blank
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return None
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        missing = list({p for c in cut if c is not None for p in c if p not in self.known})
        if len(self.known) + len(missing) > self.words:
            self.known = {}
            missing = list({p for c in cut if c is not None for p in c})
        for k in range(0, len(missing), 2000):
            some = missing[k : k + 2000]
            self.known.update(zip(some, self.encode(some)))
        known = self.known
        whole = iter(self.encode([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole) if c is None else sum(map(known.__getitem__, c)) for c in cut]


def encode_counts(misses: DataFrame, tokenizer_json: bytes) -> DataFrame:
    """(digest, n_tokens) of each (digest, text) row."""
    name = "counter_" + hashlib.sha256(tokenizer_json).hexdigest()[:12]
    shipped = misses.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(name, lambda: WordCounter(shipped.value))
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                counts = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens): one row per input row. ``cache_path``: a parquet folder all executors
    share; None starts an empty cache of this call alone."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        tokenizer_json = f.read()
    tag = tokenizer_digest(tokenizer_json)
    path = cache_path or shared_path(spark, "token-cache")
    content = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), content.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = written(texts.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    # a count may be stored twice, by a job that was run again; the copies agree
    cached = read_cache(spark, path).where(F.col("tokenizer") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = keyed.groupBy("digest").agg(F.min("id").alias("id")).join(cached, "digest", "left_anti")
    same_id = missing.select("digest", F.col("id").alias("first_id"))
    rows = texts.join(same_id, (texts.id.eqNullSafe(same_id.first_id)) & (texts.digest == same_id.digest)).select(texts.digest, "text")
    found = encode_counts(rows, tokenizer_json)
    found.select(F.lit(tag).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(path)
    counts = read_cache(spark, path).where(F.col("tokenizer") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("id", "n_bytes", "n_tokens")
