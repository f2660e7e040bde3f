"""Long repeated substrings by a run-length index.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else in the
corpus too. The work goes in four steps:

1. Anchors. In each window of ``length`` bytes the smallest hash of its ``SEED_BYTES``-byte strings
   is the window's anchor. It depends on the window's bytes alone, so equal windows have equal
   anchors at equal places. Each document is thereby cut into segments: consecutive window starts
   with one anchor, with the bytes that their windows cover. Every window start is in exactly one
   segment, and equal windows lie in segments of equal anchor hash.
2. Equal segments are one class, counted by a map-side aggregate; a class met twice is removed
   whole. An anchor with one class and one occurrence cannot repeat and goes no further.
3. The classes of an anchor are indexed together, many anchors to one index: a run-compressed
   Burrows-Wheeler transform of the segments with the text positions at run ends as samples. At a
   run end the longest match with a neighbour in suffix order is computed; at every other position
   it is the match of the position before, less one, so streaming through the text from sample to
   sample gives each position's matching statistic. Starts that match ``length`` bytes are marked.
   An anchor with more than ``GROUP`` classes is never gathered: blocks of its window starts are counted
   by 128-bit hashes, as rows of an ordinary aggregate, and cut finer only where that can matter.
4. Marks return to the documents that hold the segments, and removed runs are their union.

Defined results: null and empty texts lose nothing; texts shorter than ``length`` bytes lose nothing;
rows that repeat an id and its text are copies of each other, so what they share goes from both;
rows that repeat an id with another text are another document; null ids are allowed; an empty table
gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import packed, text_key, unpacked, written

LENGTH = 400
SEED_BYTES = 64
GROUP = 1024  # strings of at most 2 * LENGTH bytes: an index of one anchor stays within a megabyte
INDEX_BYTES = 1 << 18  # the work arrays of an index are 8 times as large and stay near the core
HOT = 2048  # keys that are joined on the map side
BASE2 = 0xD1342543DE82EF95


def sliding_min_place(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest upper half (the leftmost one)."""
    n = len(h) - width + 1
    pad = -len(h) % width
    key = np.full(len(h) + pad, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    # a window is the end of one block and the start of the next
    blocks = key.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Segments of a slice: document, first start (within the document), starts, anchor hash, content hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    prefix = tb.prefix_hash(data)
    at = np.arange(len(data) - seed + 1)
    place = sliding_min_place(tb.span_hash(prefix, at, at + seed), length - seed + 1)
    room = np.maximum(np.diff(offsets) - length + 1, 0)  # window starts of each document
    doc = np.repeat(np.arange(len(room)), room)
    starts = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(room) - room), room)
    if not len(starts):
        return none
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s, anchor = starts[first], tb.span_hash(prefix, place[first], place[first] + seed)
    content = tb.span_hash(tb.prefix_hash(data, BASE2), s, s + count - 1 + length, BASE2)
    return doc[first], s - offsets[doc[first]], count, anchor.view(np.int64), content.view(np.int64)


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of strings that each end in symbol 0, by prefix doubling. Ends differ from each
    other (in any order); ranks that are settled are not sorted again."""
    n, width = len(symbols), 7  # symbols of nine bits: seven to a first key
    key, ends = symbols.copy(), np.flatnonzero(symbols == 0)
    for k in range(1, width):
        key[:-1] = key[1:] | (symbols[:-1] << (9 * k))
        key[ends] = 0
    order = np.argsort(key)
    key = key.take(order)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (left.take(order)[1:] < width)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that share a rank
    new = new.take(tied)
    while len(tied):
        at = order.take(tied)
        key = np.maximum.accumulate(np.where(new, tied, 0)) * n  # the shared rank, then that of the next symbols
        key += rank.take(at + width)  # tied suffixes have more than ``width`` symbols
        redo = np.argsort(key)
        at, key = at.take(redo), key.take(redo)
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        still = np.flatnonzero(~(new & np.append(new[1:], True)))
        tied, new = tied.take(still), new.take(still)
        width *= 2
    return order


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a set of byte strings, with samples at run ends. Matches
    below ``least`` bytes may count as none."""

    def __init__(self, strings: list[bytes], reach: int, least: int = 0):
        lens = np.array([len(s) for s in strings])
        self.heads = np.concatenate([[0], np.cumsum(lens + 1)])
        n = int(self.heads[-1])
        self.n = n
        self.symbols = np.zeros(n, np.int64)  # 0 ends a string
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.symbols[:] = joined
        self.symbols += 1
        ends = self.heads[1:] - 1
        self.symbols[ends] = 0
        self.left = np.repeat(lens, lens + 1) - (np.arange(n) - np.repeat(self.heads[:-1], lens + 1))  # bytes left in the string
        self.prefix = tb.prefix_hash(joined)
        order = suffix_order(self.symbols, self.left)
        before = np.where(order > 0, self.symbols[order - 1], 0)
        brk = np.ones(n, bool)
        brk[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_heads = np.flatnonzero(brk)
        self.run_symbols = before[self.run_heads]
        self.head_samples = order[self.run_heads]
        self.tail_samples = order[np.append(self.run_heads[1:], n) - 1]
        # neighbours across each run border, with the bytes they share
        up, down = self.tail_samples[:-1], self.head_samples[1:]
        self.shared = np.zeros(len(up), np.int64)
        far = np.flatnonzero(np.minimum(self.left[up], self.left[down]) >= least)
        if least:
            a, b = up[far], down[far]
            far = far[tb.span_hash(self.prefix, a, a + least) == tb.span_hash(self.prefix, b, b + least)]
        self.shared[far] = self._common(up[far], down[far], reach)

    def _common(self, a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
        """Bytes that the strings at a and b share, up to ``reach``, by bisection over hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(np.minimum(self.left[a], self.left[b]), reach)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = tb.span_hash(self.prefix, a, a + mid) == tb.span_hash(self.prefix, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the bytes it shares with another position, streamed from the samples."""
        sampled = np.zeros(self.n, np.int64)  # the longer one, where a position is sampled twice
        np.maximum.at(sampled, self.head_samples[1:], self.shared)
        np.maximum.at(sampled, self.tail_samples[:-1], self.shared)
        # a position without a sample inherits the match of the one before, less one byte
        at = np.arange(self.n)
        return np.maximum(np.maximum.accumulate(sampled + at) - at, 0)


def marked_starts(strings: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string, the runs (first, last) of starts whose ``length`` bytes start elsewhere too."""
    index = RunLengthIndex(strings, max(len(s) for s in strings), length)
    ms = index.matching_statistics()
    starts, ends = tb.runs(ms >= length, index.heads)
    owner = tb.owner(starts, index.heads)
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for o, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist()):
        head = int(index.heads[o])
        out[o].append((s - head, e - 1 - head))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content_key, text): what tells rows apart; rows equal in both are copies of each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content_key"), text.alias("text"))


def _segment_table(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offs in tb.text_slices(b.column(2)):
                doc, start, count, anchor, content = segments(data, offs, length, seed)
                take = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(content)],
                    names=["id", "content_key", "start", "count", "anchor", "content"])

    return keyed.mapInArrow(run, f"id {kind}, content_key bigint, start int, count int, anchor bigint, content bigint")


def _fetch(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, content, crowded, bytes) of the segments listed in ``wanted``, cut from their texts."""
    per_text = wanted.groupBy(F.col("id").alias("id_"), F.col("content_key").alias("key_")).agg(F.collect_list(F.struct("start", "count", "anchor", "content", "crowded")).alias("parts"))
    rows = keyed.join(per_text, F.col("id").eqNullSafe(F.col("id_")) & (F.col("content_key") == F.col("key_"))).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text, parts = b.column(0)[k].as_py().encode(), b.column(1)[k].values
                start, count = parts.field(0).to_pylist(), parts.field(1).to_pylist()
                cut = [text[s : s + c - 1 + length] for s, c in zip(start, count)]
                yield pa.RecordBatch.from_arrays([parts.field(2), parts.field(3), parts.field(4), pa.array(cut, pa.binary())], names=["anchor", "content", "crowded", "bytes"])

    return rows.mapInArrow(run, "anchor bigint, content bigint, crowded boolean, bytes binary")


MARKS = "anchor bigint, content bigint, first int, last int"


def _indexed_marks(pieces: DataFrame, length: int) -> DataFrame:
    """Marks from run-length indexes, each over whole anchors of about ``INDEX_BYTES`` bytes."""

    def build(anchor: list, content: list, strings: list) -> pa.RecordBatch:
        runs = marked_starts(strings, length)
        flat = [(a, c, f, t) for a, c, r in zip(anchor, content, runs) for f, t in r]
        cols = list(zip(*flat)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "content", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, content, strings, size = [], [], [], 0
        for b in batches:
            for a, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if size > INDEX_BYTES and a != anchor[-1]:
                    yield build(anchor, content, strings)
                    anchor, content, strings, size = [], [], [], 0
                anchor.append(a)
                content.append(c)
                strings.append(s)
                size += len(s)
        if strings:
            yield build(anchor, content, strings)

    dealt = pieces.where(~F.col("crowded")).select("anchor", "content", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, MARKS)


def _blocks(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Each row's starts in blocks of ``width`` places, counted from the anchor, so that equal windows fall
    in blocks of one number. ``whole`` is the hash of a block's bytes; ``core`` that of the bytes all windows
    of a full block share, so equal windows have equal cores."""
    names = ["anchor", "content", "first", "offset", "bytes", "whole", "core"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for a, c, first, offset, raw in zip(*(col.to_pylist() for col in b.columns)):
                last = len(raw) - length  # of the row's starts; start k stands offset - k bytes before the anchor
                k = 0
                while k <= last:
                    number = (offset - k) // width
                    end = min(last, offset - number * width)
                    part = raw[k : end + length]
                    inner = offset - number * width  # the block's last place, even where the row lacks it
                    core = raw[inner : max(inner, inner - width + 1 + length)]
                    key = number.to_bytes(4, "big")
                    for n, v in zip(names, (a, c, first + k, offset - k, part, hashlib.blake2b(key + part, digest_size=16).digest(), hashlib.blake2b(key + core, digest_size=16).digest())):
                        out[n].append(v)
                    k = end + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds)], names=names)

    return rows.mapInArrow(run, "anchor bigint, content bigint, first int, offset int, bytes binary, whole binary, core binary")


def _anchored(pieces: DataFrame, length: int, seed: int) -> DataFrame:
    """Crowded segments with the place of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = []
            for anchor, raw in zip(b.column(0).to_numpy().view(np.uint64), b.column(2).to_pylist()):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(raw) - length, length - seed + 1)  # places that every window of the segment has
                h = tb.span_hash(tb.prefix_hash(data), at, at + seed)
                place.append(int(at[np.argmax(h == anchor)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.zeros(len(place), np.int32)), pa.array(place, pa.int32()), b.column(2)], names=["anchor", "content", "first", "offset", "bytes"])

    return pieces.where("crowded").select("anchor", "content", "bytes").mapInArrow(run, "anchor bigint, content bigint, first int, offset int, bytes binary")


def _counted_marks(pieces: DataFrame, length: int, seed: int) -> DataFrame:
    """Marks of the crowded anchors, by counting: blocks of starts met twice are marked whole; a block that
    is not, but whose core is met twice, is cut finer, down to single starts. A group's size
    matters to nothing but the number of rows, a few for each segment and level."""
    marks = pieces.select("anchor", "content").limit(0).withColumns({"first": F.lit(0), "last": F.lit(0)})
    rows = written(_anchored(pieces, length, seed), "crowded-segments")
    for width in (64, 16, 4, 1):
        if rows.isEmpty():
            break
        blocks = written(_blocks(rows, width, length), f"crowded-blocks-{width}")
        twice = {c: blocks.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c, F.lit(True).alias(f"{c}_twice")) for c in ("whole", "core")}
        judged = written(blocks.join(twice["whole"], "whole", "left").join(twice["core"], "core", "left").select(
            "anchor", "content", "first", "offset", "bytes", "whole", F.col("whole_twice").isNotNull().alias("met"), F.col("core_twice").isNotNull().alias("finer")), f"crowded-judged-{width}")
        marks = marks.unionByName(judged.where("met").select("anchor", "content", "first", (F.col("first") + F.length("bytes") - length).alias("last")))
        # one of the blocks that are marked stays to be met by blocks that share a part of it
        kept = ["anchor", "content", "first", "offset", "bytes"]
        partners = judged.where("finer and met").groupBy("whole").agg(F.min(F.struct(*kept)).alias("x")).select("x.*")
        rows = judged.where("finer and not met").select(*kept).unionByName(partners)
    return marks


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with a table that has each key once. The ``HOT`` heaviest keys are met on the map side, so that
    rows of a common key stay where they are; the others are joined by a shuffle."""
    hot = F.broadcast(table.orderBy(F.desc(weight), *keys).limit(HOT))  # HOT rows, whatever the corpus
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table, keys)
    return rows.join(hot, keys).unionByName(rest)


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED_BYTES, group: int = GROUP) -> DataFrame:
    """(id, content_key, spans): the byte spans [a, b) that windows of repeated strings cover, not yet
    merged, for every text that has any."""
    keyed = _keyed(docs, id_col, text_col)
    all_segments = written(_segment_table(keyed, length, seed), "segments")
    twice = written(all_segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor-counts")
    held = written(_looked_up(all_segments, twice, ["anchor"], "n").drop("n"), "repeated-anchors")
    classes = written(held.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "content_key", "start", "count")).alias("where")), "segment-classes")
    crowd = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "anchor-classes")
    wanted = _looked_up(classes, crowd, ["anchor"], "k").select("where.*", "anchor", "content", (F.col("k") > group).alias("crowded"))
    pieces = written(_fetch(keyed, wanted, length), "segment-bytes")
    whole = classes.where("n > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("where.count") - 1).alias("last"))
    marks = written(whole.unionByName(_indexed_marks(pieces, length)).unionByName(_counted_marks(pieces, length, seed)), "segment-marks")
    # the marks of a class are fewer than its window starts, so those of the commonest classes are a small table too
    per_class = marks.groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "last")).alias("runs")).join(classes.select("anchor", "content", "n"), ["anchor", "content"])
    marked = _looked_up(held, written(per_class, "class-marks"), ["anchor", "content"], "n").withColumn("run", F.explode("runs")).select("*", "run.first", "run.last")
    spans = marked.select("id", "content_key", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).alias("span"))
    return spans.groupBy("id", "content_key").agg(F.collect_list("span").alias("spans"))


def merge_spans(spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs: sorted, and joined where they overlap or touch."""
    if not spans:
        z = np.zeros(0, np.int64)
        return z, z
    ab = np.array([(s["a"], s["b"]) for s in spans], np.int64)
    ab = ab[np.argsort(ab[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ab[:, 1])
    head = np.flatnonzero(np.append(True, ab[1:, 0] > reach[:-1]))
    return ab[head, 0], reach[np.append(head[1:], len(ab)) - 1]


def kept_bytes(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    """The bytes outside the runs, in order."""
    keep = np.append(0, b), np.append(a, len(text))
    return b"".join(text[x:y] for x, y in zip(keep[0].tolist(), keep[1].tolist()))


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of (id, text, ...) with their ``spans`` (null: none)."""
    found = spans.select(F.col("id").alias("span_id"), F.col("content_key").alias("span_key"), "spans")
    return rows.join(found, F.col("id").eqNullSafe(F.col("span_id")) & (text_key() == F.col("span_key")), "left").drop("span_id", "span_key")


def removal_digest(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, n, sha = [], [], [], []
            for k in range(b.num_rows):
                text = (b.column(1)[k].as_py() or "").encode()
                a, e = merge_spans(b.column(2)[k].as_py())
                size.append(len(text))
                gone.append(int((e - a).sum()))
                n.append(len(a))
                sha.append(hashlib.sha256(kept_bytes(text, a, e) if len(a) else text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated strings cut out and ``n_chars`` counted anew; all other columns stay as
    they were, whatever their names.

    A character goes only if all its bytes are repeated, so the rest is valid text. A document that
    loses its whole text is dropped; one that was null or empty before stays as it was.
    """
    rows = _with_spans(packed(docs, id=F.col("doc_id"), text=F.col("text")), repeat_spans(docs, length=length)).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column(1).to_pylist(), b.column(2)
            for k in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                raw = texts[k].encode()
                a, e = merge_spans(found[k].as_py())
                inside = np.frombuffer(raw + b"a", np.uint8) & 0xC0 == 0x80  # bytes that continue a character
                while (move := inside[a]).any():  # into a character: leave that character whole
                    a = a + move
                while (move := inside[e]).any():
                    e = e - move
                some = a < e
                texts[k] = kept_bytes(raw, a[some], e[some]).decode()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type), found.is_valid()], names=["row", "text", "cut"])

    fields = [rows.schema["row"], rows.schema["text"], T.StructField("cut", T.BooleanType())]
    left = rows.mapInArrow(run, T.StructType(fields)).where("not cut or text <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        old = F.col("row")["n_chars"]
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return unpacked(left, docs.columns, **new)
