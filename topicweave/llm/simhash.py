"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints come from whole texts. Equal fingerprints are one class. Two classes within the
radius agree in at least one of ``radius + 1`` blocks of bits, so classes are first laid out by
(block, block value); inside such a cell they are ordered by population count and cut into tiles
of about ``TILE`` members, and tiles are compared in pairs with numpy exclusive-or and bit counts.
A tile pair whose population counts differ by more than the radius is never formed, and inside a
pair each strip meets only the columns within the radius. A cell with a third of all classes is
therefore many tiles, spread over many tasks. A tile pair returns a spanning forest of its links
(at most one row per member), which keeps every component and never lists all pairs of a group.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated
rows share their fingerprint and component; a component without any non-null id has a null id; an
empty table gives no rows; other columns of the input are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.llm import textbytes as tb
from topicweave.llm.components import components
from topicweave.llm.tables import packed, text_key, unpacked, written

TILE = 512
STRIP = 128
SEED = 42
# the five fixed 64-bit primes of XXH64
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of ``data``, all spans of one length at a time."""
    u, mask = np.uint64, (1 << 64) - 1
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data)
    w64 = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n + 1,), (1,))
    w32 = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (n + 1,), (1,))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            at, length = starts[rows].copy(), int(lengths[rows[0]])
            rest = length
            if length >= 32:
                acc = [np.full(len(at), v & mask, np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                while rest >= 32:
                    for k in range(4):
                        acc[k] = _rotl(acc[k] + w64[at + 8 * k] * u(P2), 31) * u(P1)
                    at += 32
                    rest -= 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for v in acc:
                    h = (h ^ (_rotl(v * u(P2), 31) * u(P1))) * u(P1) + u(P4)
            else:
                h = np.full(len(at), (seed + P5) & mask, np.uint64)
            h = h + u(length)
            while rest >= 8:
                h = _rotl(h ^ (_rotl(w64[at] * u(P2), 31) * u(P1)), 27) * u(P1) + u(P4)
                at += 8
                rest -= 8
            if rest >= 4:
                h = _rotl(h ^ (w32[at].astype(np.uint64) * u(P1)), 23) * u(P2) + u(P3)
                at += 4
                rest -= 4
            while rest:
                h = _rotl(h ^ (data[at].astype(np.uint64) * u(P5)), 11) * u(P1)
                at += 1
                rest -= 1
            h = (h ^ (h >> u(33))) * u(P2)
            h = (h ^ (h >> u(29))) * u(P3)
            out[rows] = h ^ (h >> u(32))
    return out


def slice_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    docs = len(offsets) - 1
    low = tb.lower_table()[data]
    starts, ends = tb.runs(~tb.space_table()[low], offsets)
    doc = tb.owner(starts, offsets)
    # words joined by one blank each, documents one after another
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    take = np.repeat(starts - at[:-1], lens) + (w := np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens))
    joined[w] = low[take]
    n_words = np.bincount(doc, minlength=docs)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    width = np.minimum(n_words, shingle)
    n_sh = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    sh_doc = np.repeat(np.arange(docs), n_sh)
    head = np.arange(int(n_sh.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n_sh)[:-1]]), n_sh) + first_word[sh_doc]
    tail = head + width[sh_doc] - 1
    h = xxh64_spans(joined, at[head], at[tail] + lens[tail] - at[head])
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    out = np.zeros(docs, np.uint64)
    cut = np.concatenate([[0], np.cumsum(n_sh)])
    lanes = h.view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
    for d in np.flatnonzero(n_sh):
        seen = np.bincount(lanes[cut[d] : cut[d + 1]].ravel(), minlength=2048).reshape(8, 256) @ table
        out[d] = np.packbits(seen.ravel() * 2 > n_sh[d], bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint): the SimHash of each whole text over ``shingle``-word shingles; ids of any type that can be ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [slice_fingerprints(data, offs, shingle) for _, data, offs in tb.text_slices(b.column(1))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links inside tile ``a``, or between ``a`` and ``b``."""
    both = a if b is None else np.concatenate([a, b])
    nodes, inv = np.unique(both, return_inverse=True)
    pops = np.bitwise_count(nodes).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    nodes, pops = nodes[order], pops[order]
    root = np.arange(len(nodes))
    for s in range(0, len(nodes), STRIP):
        e = min(s + STRIP, len(nodes))
        hi = int(np.searchsorted(pops, pops[e - 1] + radius, "right"))
        i, j = np.nonzero(np.bitwise_count(nodes[s:e, None] ^ nodes[None, s:hi]) <= radius)
        i, j = i + s, j + s
        while True:
            ri, rj = root[i], root[j]
            live = ri != rj
            if not live.any():
                break
            i, j, ri, rj = i[live], j[live], ri[live], rj[live]
            least = np.minimum(ri, rj)
            np.minimum.at(root, ri, least)
            np.minimum.at(root, rj, least)
            while not np.array_equal(root, root[root]):
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(classes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) fingerprint links that connect exactly what pairs within ``radius`` bits connect."""
    blocks = radius + 1
    bounds = [round(k * 64 / blocks) for k in range(blocks + 1)]
    cells = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", bounds[k]).bitwiseAND((1 << (bounds[k + 1] - bounds[k])) - 1).alias("value")) for k in range(blocks)])
    laid = classes.select("fp", F.bit_count("fp").alias("pop"), F.inline(cells))
    # where each population count of a cell starts, from counts alone
    hist = laid.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.selectExpr("block", "value", "pop", "n", "sum(n) over (partition by block, value) total",
                           "sum(n) over (partition by block, value order by pop) - n ahead").where("total > 1")
    placed = laid.join(hist, ["block", "value", "pop"]).select(
        "block", "value", "pop", "fp", F.floor((F.col("ahead") + F.pmod(F.xxhash64("fp"), F.col("n"))) / tile).cast("int").alias("tile"))
    tiles = written(placed.groupBy("block", "value", "tile").agg(
        F.collect_list("fp").alias("fps"), F.min("pop").alias("lo"), F.max("pop").alias("hi")), "tiles")
    meta = tiles.select("block", "value", "tile", "lo", "hi")
    other = meta.select("block", "value", F.col("tile").alias("with"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # tiles follow each other in population order; pairs further apart than the radius are skipped
    far = meta.join(other, ["block", "value"]).where((F.col("with") > F.col("tile")) & (F.col("lo2") <= F.col("hi") + radius)).select("block", "value", "tile", "with")
    right = tiles.select("block", "value", F.col("tile").alias("with"), F.col("fps").alias("other"))
    crossed = far.join(tiles.select("block", "value", "tile", "fps"), ["block", "value", "tile"]).join(right, ["block", "value", "with"])
    pairs = tiles.select("fps", F.lit(None).cast("array<bigint>").alias("other"), F.hash("block", "value", "tile").alias("deal")).unionByName(
        crossed.select("fps", "other", F.hash("block", "value", "tile", "with").alias("deal"))).repartition("deal").drop("deal")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(0), b.column(1)
            out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for k in range(b.num_rows):
                y = right[k]
                found = tile_links(left[k].values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64) if y.is_valid else None, radius)
                out_a.append(found[0])
                out_b.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id that links reach."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes, radius, tile)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(smallest, "root").select("fp", "component")
    return fps.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one document of each near-duplicate group: the one with the smallest id, all columns as
    they were.

    Rows that share an id but not a text are different documents; of those with a group's smallest id the
    one with the smallest text hash stays. Of rows that repeat an id and its text one stays. Rows without an id stay
    only where no row of their group has one.
    """
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), text_key().alias("key"))
    rows = packed(docs, own=own, text=F.col("text"))
    found = near_duplicates(rows, "own", "text", shingle, radius)
    keep = found.where(F.col("id") == F.col("component")).select(F.col("id.id").alias("keep_id"), F.col("id.key").alias("keep_key")).distinct()
    kept = rows.select("row", "own.id", "own.key").join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")), "left_semi")
    order = Window.partitionBy("id", "key").orderBy(F.xxhash64("row"))
    return unpacked(kept.withColumn("nth", F.row_number().over(order)).where("nth = 1"), docs.columns)
