"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased letter runs, held as 64-bit hashes. The word n-grams of the test items set the
bits of a bitmap of fixed size; tasks over the corpus pass on only the n-grams whose bit is set, and an
exact join with the items' n-grams drops the rest. How often each n-gram occurs in the corpus then
decides which are seeds: those within ``RARE`` times the frequency of their item's rarest one, and in any
``WINDOW`` consecutive n-grams of an item the rarest one, so a shared run of ``n + WINDOW - 1`` words always
has a seed. Each document place that a seed names is aligned with the whole item, in a window that holds
every local alignment through the seed, however many words are inserted; the similarity
is the share of the item's words that the best local alignment matches.

Defined results: null and empty texts and items match nothing; an item of fewer than ``n`` words cannot
be told from an ordinary phrase and is never reported, nor is one without an id; repeated items are reported under each id, rows
that repeat an id and its text once; null ids are allowed; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import packed, text_key, unpacked, written

GRAM = 5
RARE = 16
WINDOW = 4
SIMILARITY = 0.8
BITS = 24  # the bitmap has 2**24 bits: 2 MB, whatever the benchmark
UNIT = 1 << 32  # a score point, above the count of matches
SLACK = 2  # item lengths: a match scores 2 and a gap costs 1 a word, so no alignment has more words inserted


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word of a slice."""
    low = tb.lower_table()[data]
    starts, ends = tb.runs(tb.letter_table()[low], offsets)
    return tb.owner(starts, offsets), tb.span_hash(tb.prefix_hash(low), starts, ends)


def grams(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n-gram inside one document."""
    at = tb.pairs_within(doc, n)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = tb.mix(h + words[at + k])
    return at, h


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content_key"), text.alias("text"))


def _items(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, words array<bigint>) of items of at least ``n`` words."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offs in tb.text_slices(b.column(1)):
                doc, h = word_hashes(data, offs)
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])
                words = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(words)), words], names=["item_id", "words"])

    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null and item_id is not null").distinct()
    return rows.mapInArrow(run, f"item_id {kind}, words array<bigint>").where(F.size("words") >= n)


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = b.column(1).value_lengths().to_numpy()
            words = b.column(1).flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(len(lens)), lens)
            at, h = grams(doc, words, n)
            pos = at - (np.cumsum(lens) - lens)[doc[at]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[at])), pa.array(pos.astype(np.int32)), pa.array(lens[doc[at]].astype(np.int32)), pa.array(h.view(np.int64))],
                                             names=["item_id", "item_pos", "n_words", "gram"])

    return items.mapInArrow(run, f"item_id {kind}, item_pos int, n_words int, gram bigint")


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash in ``column``, gathered as at most 2**(BITS - 6) words of 64 bits."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITS}) & 63 as int))")
    words = rows.groupBy(F.shiftrightunsigned(column, 64 - BITS + 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _only_marked(keyed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows whose content key has its bit set, dropped before their texts are shuffled."""
    shipped = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for b in batches:
            yield b.filter(pa.array(_has_bit(bits, b.column(1).to_numpy().view(np.uint64))))

    return keyed.mapInArrow(run, keyed.schema)


def _hits(keyed: DataFrame, bitmap: np.ndarray, n: int) -> DataFrame:
    """(id, content_key, pos, gram) of the corpus n-grams whose bit is set."""
    kind = keyed.schema["id"].dataType.simpleString()
    shipped = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for b in batches:
            for row, data, offs in tb.text_slices(b.column(2)):
                doc, words = word_hashes(data, offs)
                at, h = grams(doc, words, n)
                hit = _has_bit(bits, h)
                at, h = at[hit], h[hit]
                first = np.searchsorted(doc, np.arange(len(offs) - 1))
                take = pa.array(row + doc[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(h.view(np.int64))],
                                                 names=["id", "content_key", "pos", "gram"])

    return keyed.mapInArrow(run, f"id {kind}, content_key bigint, pos int, gram bigint")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, matches, end) of the best local alignment: match 2, mismatch and gap -1, ties to more
    matches. A cell holds score * UNIT + matches; a row of the table is one vector."""
    ahead = np.arange(len(passage) + 1, dtype=np.int64) * UNIT
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.where(passage == word, 2 * UNIT + 1, -UNIT)
        new = np.maximum(row - UNIT, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        # a gap in the item costs one per word: the running maximum of value + distance
        row = np.maximum(np.maximum.accumulate(new + ahead) - ahead, 0)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best // UNIT, best % UNIT, end


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, first, end) of the best local alignment; the start comes from the mirror image."""
    score, matches, end = align(item, passage)
    if not score:
        return 0, 0, 0, 0
    _, _, back = align(item[::-1], passage[:end][::-1])
    return score, matches, end - back, end


def spans(item_ids: list, lo: np.ndarray, hi: np.ndarray, n_words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(index of a place of the item, first, last): the starts of each item in order, chained while they are no
    more than its length apart."""
    order = sorted(range(len(item_ids)), key=lambda j: (item_ids[j], lo[j]))
    k = 0
    while k < len(order):
        j = order[k]
        first, last = int(lo[j]), int(hi[j])
        k += 1
        while k < len(order) and item_ids[order[k]] == item_ids[j] and lo[order[k]] - last <= n_words[j]:
            last = max(last, int(hi[order[k]]))
            k += 1
        yield j, first, last


def alignments(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               similarity: float = SIMILARITY, n: int = GRAM) -> DataFrame:
    """(id, content_key, item_id, score, similarity, first_word, end_word): the best alignment of each
    document with each item that it holds to at least ``similarity``."""
    keyed = _keyed(docs, id_col, text_col)
    items = written(_items(benchmark, item_col, item_text, n), "benchmark-items")
    item_grams = written(_item_grams(items, n), "benchmark-grams")
    hits = _hits(keyed, _bitmap(item_grams, "gram"), n)
    hits = written(hits.join(item_grams.select("gram").distinct(), "gram"), "benchmark-hits")
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    known = item_grams.join(often, "gram")  # an n-gram that the corpus lacks cannot be a seed
    ranked = known.selectExpr("*", "min(often) over (partition by item_id) as rarest",
                              f"min(struct(often, item_pos)) over (partition by item_id order by item_pos range between current row and {WINDOW - 1} following).item_pos as chosen")
    chosen = ranked.select("item_id", F.col("chosen").alias("item_pos")).distinct().withColumn("picked", F.lit(True))
    seeds = ranked.join(chosen, ["item_id", "item_pos"], "left").where((F.col("often") <= RARE * F.col("rarest")) | F.col("picked")).select("item_id", "item_pos", "n_words", "gram")
    # starts within an item's length are gathered here, by fixed ranges, and chained over ranges in spans()
    start = F.col("pos") - F.col("item_pos")
    places = hits.join(seeds, "gram").groupBy("id", "content_key", "item_id", F.floor(start / F.col("n_words")).alias("place")).agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    wanted = places.join(items, "item_id").groupBy(F.col("id").alias("id_"), F.col("content_key").alias("key_")).agg(F.collect_list(F.struct("item_id", "lo", "hi", "words")).alias("places"))
    wanted = written(wanted, "benchmark-places")
    rows = _only_marked(keyed, _bitmap(wanted, "key_")).join(wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("content_key") == F.col("key_")))
    rows = rows.dropDuplicates(["id", "content_key"]).select("id", "content_key", "text", "places")
    kinds = keyed.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "content_key", "item_id", "score", "similarity", "first_word", "end_word"]
        for b in batches:
            for k in range(b.num_rows):
                raw = np.frombuffer(b.column(2)[k].as_py().encode(), np.uint8)
                _, doc = word_hashes(raw, np.array([0, len(raw)]))
                places, out = b.column(3)[k].values, []
                lo, hi = places.field(1).to_numpy(), places.field(2).to_numpy()
                for j, first_start, last_start in spans(places.field(0).to_pylist(), lo, hi, places.field(3).value_lengths().to_numpy()):
                    item = places.field(3)[j].values.to_numpy().view(np.uint64)
                    slack = SLACK * len(item)
                    a, e = max(0, first_start - slack), last_start + len(item) + slack
                    score, matches, first, end = aligned(item, doc[a:e])
                    if matches >= similarity * len(item):
                        out.append((j, score, matches / len(item), a + first, a + end))
                if out:
                    j, score, share, first, end = zip(*out)
                    at = pa.array([k] * len(out))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), places.field(0).take(pa.array(j)), pa.array(score, pa.int64()), pa.array(share, pa.float64()),
                                                      pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=names)

    found = rows.mapInArrow(run, f"id {kinds[0]}, content_key bigint, item_id {kinds[1]}, score bigint, similarity double, first_word bigint, end_word bigint")
    best = F.max(F.struct("similarity", "score", (-F.col("first_word")).alias("back"), "end_word")).alias("x")
    return found.groupBy("id", "content_key", "item_id").agg(best).select("id", "content_key", "item_id", "x.score", "x.similarity", (-F.col("x.back")).alias("first_word"), "x.end_word")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item of the benchmark to ``similarity``, with all their columns, whatever
    their names."""
    found = alignments(docs, benchmark, similarity=similarity).select(F.col("id").alias("bad_id"), F.col("content_key").alias("bad_key")).distinct()
    bad = written(found, "contaminated")
    rows = packed(docs, id=F.col("doc_id"), key=text_key())
    kept = rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti")
    return unpacked(kept, docs.columns)
