"""Language identification by compression.

For each language that the training rows name, a zstandard dictionary of raw content is cut from a
bounded sample of its texts. The whole text is compressed with every language's dictionary, in
pieces of at most ``SPAN`` bytes that know nothing of each other, so that a text never stands in for
the dictionary. The sizes of all pieces are summed by language, and the language with the smallest
sum is chosen; where the second smallest is within ``MARGIN`` of it, the choice is marked as rejected
(the language is still named).

Bounds: ``SAMPLE`` texts a language, first by a hash of the id, of which a piece of at most
``PIECE`` characters each is taken, from a place chosen by the hash, until ``DICTIONARY`` bytes are
full. The dictionaries are sent to the executors: one of that size for each language of the training rows.

Defined results: ``und`` (score 0) for texts that are null or have no letter, and for all texts when
there is nothing to learn from; equal sizes go to the language with more training rows; repeated rows
are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.tables import held_out

SAMPLE = 300
PIECE = 600
DICTIONARY = 1 << 16
SPAN = 1 << 10  # bytes compressed at a time
MARGIN = 0.02  # share of the smallest size
UNKNOWN = "und"


def letters_only(text: str) -> bytes:
    """Lower-cased text with every ASCII character that is no letter turned into a blank, blanks joined."""
    table = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
    return b" ".join(text.lower().encode().translate(table).split())


def dictionaries(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw dictionary content by language, the most frequent one first, from rows that may be learned from."""
    rows = docs.where(~held_out()).where("lang is not null and text is not null")
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("order_"))
    rows = rows.selectExpr("lang", "order_", f"substring(text, 1 + cast(pmod(order_, greatest(char_length(text) - {PIECE} + 1, 1)) as int), {PIECE}) as piece")
    first = rows.selectExpr("*", "row_number() over (partition by lang order by order_) as nth").where(f"nth <= {sample}")
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in first.select("lang", "nth", "piece").toLocalIterator():
        texts.setdefault(r.lang, []).append((r.nth, letters_only(r.piece)))
    out = {}
    for lang, found in sorted(texts.items(), key=lambda x: (-many[x[0]], x[0])):
        content = b" ".join(t for _, t in sorted(found) if t)[:DICTIONARY]
        if content:
            out[lang] = content
    return out


class Compressors:
    """One zstandard compressor a language, over its prepared dictionary."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.langs, self.by_lang = list(content), []
        for lang in self.langs:
            params = z.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=z.STRATEGY_GREEDY,
                                                 format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_lang.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, raw: bytes) -> list[int]:
        """By language, the summed sizes of the pieces of ``raw``; the pieces are of about one length."""
        n = -(-len(raw) // SPAN)
        cuts = [len(raw) * k // n for k in range(n + 1)]
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.by_lang]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is 0.5 at a tie and rises with the margin."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = letters_only(text) or text.encode()
        sizes = sorted(zip(self.sizes(raw), self.langs), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        gap = (sizes[1][0] - sizes[0][0]) / sizes[0][0]
        return sizes[0][1], 1 - 0.5 / (1 + 10 * gap), gap < MARGIN


def languages(docs: DataFrame, learn_from: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries(docs if learn_from is None else learn_from, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Compressors(shipped.value).judge
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                lang, score, rejected = zip(*map(judge, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
