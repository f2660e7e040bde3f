"""Phrase collocations by dynamic itemset counting.

Phrases are runs of words inside a piece of text, counted per language. The corpus is written once in
``SHARDS`` shards, which are scanned in a circle, one Spark job a shard. A scan counts phrases of several
lengths at once:

* words from the first scan on;
* a longer phrase as soon as both of its subphrases (without the last word, without the first) are seen to have
  reached ``least`` occurrences in what has been scanned so far, and from then for one full circle. Between
  two scans this is judged from the phrases that a task met twice or more, which leaves out the long
  tail; at the end of circle k from all counts of k words, which are complete by then.

A phrase cannot occur more often than its subphrases, so every phrase that reaches ``least`` is
counted over all shards. What a task may skip it reads from bitmaps of the reached phrases, at most
``MOST_BITS`` bits each however large the corpus. A false bit costs a row and nothing else: a phrase's count in a
shard is the same whenever it is taken, and each shard's count enters its total once.

A word is known by a 64-bit hash of itself and its language; the table of counted words shows whether two
words share a hash, and then all is counted again under another seed, so the keys are exact. Longer phrases
are the hashes of their words, side by side.

Tasks hand on one row per different phrase of what they read (in groups of at most ``HELD`` occurrences),
so a very common phrase is a few rows, not a hot group.

Defined results: null and empty texts have no phrases; a null language is ``und``, together with rows that say so;
repeated rows and ids count each time; very long texts are read whole; ties go by count, then by
phrase in byte order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import shared_path, written

SHARDS = 2
LONGEST = 4
LEAST = 30
TOP = 2000
LONG_WORD = 255  # bytes; the words beyond are hashed one by one
SECOND = 0xD1342543DE82EF95
HELD = 1 << 20  # occurrences gathered in a task before they are counted and handed on
LEAST_BITS, MOST_BITS = 16, 27  # a bitmap has 2**16 to 2**27 bits (16 MB), 32 or more for each phrase while that fits
SALTS = 8  # parts of a phrase are looked up in so many copies of the small table of phrases
KEYS = [f"h{i}" for i in range(1, LONGEST + 1)]
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"


def word_places(texts: pa.Array, langs: np.ndarray, seed: int) -> Iterator[tuple]:
    """For each slice: its bytes (A-Z lower-cased) and of each word the start, the end, the row, the hash and the
    number of its piece."""
    ends, blanks, low = tb.byte_table(PIECE_ENDS), tb.byte_table(b" \t" + PIECE_ENDS), tb.lower_table()
    for row, data, offs in tb.text_slices(texts):
        data = low[data]
        starts, stops = tb.runs(~blanks[data], offs)
        if not len(starts):
            continue
        owner = tb.owner(starts, offs)
        h = word_hashes(data, starts, stops, tb.BASE, seed)
        yield data, starts, stops, row + owner, tb.mix(h + langs[row + owner]), np.cumsum(ends[data])[starts] + owner


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int, seed: int) -> np.ndarray:
    base += 2 * seed
    h = tb.span_hash(tb.prefix_hash(data, base), starts, stops, base)
    for i in np.flatnonzero(stops - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), base & 0xFFFFFFFF)
    return h


def cut_out(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    lens = stops - starts
    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    raw = data[np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])]
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offs.tobytes()), pa.py_buffer(raw.tobytes()))


def language_hashes(langs: pa.Array, seed: int) -> np.ndarray:
    """A hash of each row's language, null as ``und``."""
    code = pc.fill_null(langs, "und").dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(v.as_py().encode(), seed) for v in code.dictionary], np.uint64)
    return known[code.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def slot(columns: list, bits: int):
    """The bitmap place of a phrase, from the hashes of its words (numpy arrays of unsigned 64 bits)."""
    h = columns[0]
    for c in columns[1:]:
        h = tb.mix(h) + c
    return tb.mix(h) >> np.uint64(64 - bits)


def has_bit(bitmap: np.ndarray, columns: list) -> np.ndarray:
    place = slot(columns, len(bitmap).bit_length() + 5)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def bitmaps(reached: DataFrame, sizes: dict[int, int], since: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the bitmaps of the phrases reached at all, and of those from scan ``since`` on: 32 bits a
    phrase, within the bounds. Tasks set the bits; the driver gets at most one row for each 64 of them."""
    width = {k: min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length())) for k, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, scan = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys = [c.to_numpy().view(np.uint64) for c in b.columns[2:]]
            for k, bits in width.items():
                at = np.flatnonzero(length == k)
                if not len(at):
                    continue
                place = slot([c[at] for c in keys[:k]], bits)
                order = np.argsort(place)
                word, bit = (place >> np.uint64(6))[order].astype(np.int64), np.uint64(1) << (place[order] & np.uint64(63))
                late = np.where(scan[at][order] >= since, bit, np.uint64(0))
                head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(head), k, np.int32)), pa.array(word[head]), pa.array(np.bitwise_or.reduceat(bit, head).view(np.int64)),
                    pa.array(np.bitwise_or.reduceat(late, head).view(np.int64))], names=["k", "word", "bits", "late"])

    rows = reached.select("k", "scan", *KEYS).mapInArrow(run, "k int, word bigint, bits bigint, late bigint")
    got = rows.groupBy("k", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("late").alias("late")).toArrow()
    length, word = got.column("k").to_numpy(), got.column("word").to_numpy()
    out = {}
    for k, bits in width.items():
        pair = np.zeros((2, 1 << (bits - 6)), np.uint64)
        for line, name in zip(pair, ("bits", "late")):
            line[word[length == k]] = got.column(name).to_numpy()[length == k].view(np.uint64)
        if pair[1].any():  # else no longer phrase can start to count
            out[k] = (pair[0], pair[1])
    return out


def counted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(different rows, their counts, a place of each). Two rows that share a hash may come out in several parts."""
    order = np.argsort(slot(columns, 64) if len(columns) > 1 else columns[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(order))) if counts is None else np.add.reduceat(counts[order], head)
    return [c[order][head] for c in columns], n, order[head]


def _scan(shard: DataFrame, number: int, scan: int, words_too: bool, maps: dict, longest: int, seed: int) -> DataFrame:
    """(shard, scan, k, h1 .. h4, n, lang, word) of one shard's active phrases; ``lang`` and ``word`` for words alone."""
    shipped = shard.sparkSession.sparkContext.broadcast(maps)
    names = ["shard", "scan", "k", *KEYS, "n", "lang", "word"]

    def rows(k: int, keys: list[np.ndarray], n: np.ndarray, lang: pa.Array | None = None, word: pa.Array | None = None) -> pa.RecordBatch:
        fixed = [pa.array(np.full(len(n), v, np.int32)) for v in (number, scan, k)]
        keys = [x.view(np.int64) for x in keys] + [np.zeros(len(n), np.int64)] * (LONGEST - len(keys))
        none = pa.nulls(len(n), pa.string())
        return pa.RecordBatch.from_arrays([*fixed, *[pa.array(x) for x in keys], pa.array(n.astype(np.int64)), none if lang is None else lang, none if word is None else word], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = shipped.value
        held: dict[int, list] = {k: [] for k in range(1, longest + 1)}
        size = dict.fromkeys(held, 0)

        def flush(k: int) -> pa.RecordBatch:
            columns = list(zip(*held[k]))
            held[k], size[k] = [], 0
            if k > 1:
                keys, n, _ = counted([np.concatenate(c) for c in columns])
                return rows(k, keys, n)
            h, other, n, lang, word = columns
            keys, n, at = counted([np.concatenate(h), np.concatenate(other)], np.concatenate(n))
            return rows(1, keys[:1], n, pa.concat_arrays(list(lang)).take(pa.array(at)), pa.concat_arrays(list(word)).take(pa.array(at)))

        for b in batches:
            langs = pc.fill_null(b.column(1), "und")
            for data, starts, stops, row, h, piece in word_places(b.column(0), language_hashes(langs, seed), seed):
                if words_too:
                    # a second hash keeps words apart that share the first, so that the table of words shows them
                    (key, other), n, at = counted([h, word_hashes(data, starts, stops, SECOND, seed)])
                    held[1].append((key, other, n, langs.take(pa.array(row[at])), cut_out(data, starts[at], stops[at])))
                    size[1] += len(key)
                for k in range(2, longest + 1):
                    if k - 1 not in active or len(h) < k:
                        continue
                    everything, recent = active[k - 1]
                    parts = [h[i : len(h) - k + 2 + i] for i in range(k - 1)]  # the phrases of k - 1 words
                    reached = has_bit(everything, parts)
                    at = np.flatnonzero(reached[:-1] & reached[1:] & (piece[: len(h) - k + 1] == piece[k - 1 :]))
                    at = at[has_bit(recent, [p[at] for p in parts]) | has_bit(recent, [p[at + 1] for p in parts])]
                    if len(at):
                        held[k].append([h[at + i] for i in range(k)])
                        size[k] += len(at)
                for k in held:
                    if size[k] > HELD:
                        yield flush(k)
        for k in held:
            if held[k]:
                yield flush(k)

    keys = ", ".join(f"{k} bigint" for k in KEYS)
    return shard.select("text", "lang").mapInArrow(run, f"shard int, scan int, k int, {keys}, n bigint, lang string, word string")


def _totals(rows: DataFrame, scans: list[int], shards: int, k: int | None = None) -> DataFrame:
    """(k, h1 .. h4, n) of the phrases of ``k`` words, or of any length: each shard's count of a phrase once, however
    many of ``scans`` took it."""
    keys = KEYS[:k] if k else ["k", *KEYS]
    own = rows.where(F.col("k") == k) if k else rows
    by_scan = [F.coalesce(F.sum(F.when(F.col("scan") == t, F.col("n"))), F.lit(0)).alias(f"n{t}") for t in scans]
    sums = own.select(*keys, "scan", "n").repartition(*keys).groupBy(*keys).agg(*by_scan)
    of_shard = [[F.col(f"n{t}") for t in scans if t % shards == i] for i in range(shards)]
    total = reduce(lambda x, y: x + y, [F.greatest(*c) if len(c) > 1 else c[0] for c in of_shard if c])
    rest = [F.lit(0).cast("bigint").alias(x) for x in KEYS if x not in keys]
    return sums.select(*([] if "k" in keys else [F.lit(k).alias("k")]), *keys, *rest, total.alias("n"))


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                  shards: int = SHARDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (h1, lang, word, n) of every word, and (k, h1 .. h4, n) of every phrase of 2 to ``longest``
    words with at least ``least`` occurrences, counted by dynamic itemset counting."""
    spark = docs.sparkSession
    path = shared_path(spark, "phrase-shards")
    own = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    own.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    corpus = spark.read.schema(own.schema).parquet(path)
    scans: list[DataFrame] = []
    taken: list[int] = []
    known: DataFrame | None = None  # (scan, k, h1 .. h4) of the phrases that have reached the count
    sizes: dict[int, int] = {}
    totals: list[DataFrame] = []
    words, maps = None, {}
    for t in range(longest * shards):
        circle, rest = divmod(t + 1, shards)
        if t < shards or maps:
            taken.append(t)
            scans.append(written(_scan(corpus.where(F.col("shard") == t % shards), t % shards, t, t < shards, maps, longest, seed), f"phrase-scan-{t}", "zstd"))
        elif rest:
            continue  # nothing is active before the next circle
        rows = reduce(DataFrame.unionByName, scans)
        # on the way, what tasks met at least twice is enough to see that a phrase has reached the count
        new = _totals(rows.where((F.col("k") > circle) & (F.col("k") < longest) & (F.col("n") > 1)), taken, shards).where(F.col("n") >= least)
        if rest == 0 and circle == 1:
            pair = F.struct("lang", "word")
            words = written(rows.where("k = 1").groupBy("h1").agg(F.sum("n").alias("n"), F.min(pair).alias("low"), F.max(pair).alias("high")), "phrase-words")
            if not words.where("low <> high").isEmpty():  # two words share a hash
                return count_phrases(docs, text_col, lang_col, least, longest, shards, seed + 1)
            words = words.select("h1", "low.lang", "low.word", "n")
            zero = [F.lit(0).cast("bigint").alias(x) for x in KEYS[1:]]
            new = new.unionByName(words.where(F.col("n") >= least).select(F.lit(1).alias("k"), "h1", *zero, "n"))
        elif rest == 0:  # all phrases of ``circle`` words have had their circle
            totals.append(written(_totals(rows, taken, shards, circle).where(F.col("n") >= least), f"phrase-totals-{circle}"))
            new = new.unionByName(totals[-1])
        if circle == longest:
            break
        new = new.select(F.lit(t).alias("scan"), "k", *KEYS)
        if known is not None:
            new = new.join(known, ["k", *KEYS], "left_anti").select("scan", "k", *KEYS)
        new = written(new, f"phrase-reached-{t}")
        known = new if known is None else known.unionByName(new)
        for r in new.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["k"]] = sizes.get(r["k"], 0) + r["n"]
        # a phrase that may be activated now is counted in the scans t + 1 .. t + shards
        maps = bitmaps(known, sizes, t + 1 - shards) if sizes else {}
    return words, reduce(DataFrame.unionByName, totals)


def _slice(first: int, count: int) -> list:
    """The key columns of ``count`` words of a phrase, from the word ``first`` on."""
    return [F.col(KEYS[first + i]) if i < count else F.lit(0).cast("bigint") for i in range(LONGEST)]


def _part(use: str, at: int, first: int, count: int):
    """A subphrase as a struct: what it is looked up for, and its key."""
    key = [c.alias(f"p{i}") for i, c in enumerate(_slice(first, count))]
    return F.struct(F.lit(use).alias("use"), F.lit(at).alias("at"), F.lit(count).alias("pk"), *key)


def _each_length(phrases: DataFrame, parts_of) -> DataFrame:
    """One row (.., part) for each of the parts that ``parts_of`` names for a phrase's length."""
    choice = None
    for k in range(2, LONGEST + 1):
        if found := parts_of(k):
            choice = F.when(F.col("k") == k, F.array(*found)) if choice is None else choice.when(F.col("k") == k, F.array(*found))
    return phrases.withColumn("part", F.explode(choice))


def scored_phrases(words: DataFrame, phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """(k, h1 .. h4, lang, phrase, a, l, r, score) of every phrase, by its lowest-scoring cut."""
    zero = [F.lit(0).cast("bigint").alias(x) for x in KEYS[1:]]
    table = words.where(F.col("n") >= least).select(F.lit(1).alias("k"), "h1", *zero, "n", "lang", "word").unionByName(
        phrases.where(F.col("k") < LONGEST).select("k", *KEYS, "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")))
    names = ["pk", *[f"p{i}" for i in range(LONGEST)]]
    # a common word is part of many phrases: the phrases are dealt by a salt too, the table repeated for each
    table = table.select(*[F.col(x).alias(y) for x, y in zip(["k", *KEYS], names)], F.col("n").alias("f"), "lang", "word", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = lambda k: [_part(use, j, first, n) for j in range(1, k) for use, first, n in (("l", 0, j), ("r", j, k - j))]
    rows = _each_length(phrases, lambda k: cuts(k) + [_part("w", i, i, 1) for i in range(k)])
    rows = rows.select("k", *KEYS, F.col("n").alias("a"), "part.*", F.pmod(F.xxhash64("k", *KEYS), F.lit(SALTS)).cast("int").alias("salt"))
    met = rows.join(table, [*names, "salt"])
    of = lambda use, at, value: F.max(F.when((F.col("use") == use) & (F.col("at") == at), F.col(value)))
    got = met.groupBy("k", *KEYS, "a").agg(
        F.max("lang").alias("lang"),
        *[of("w", i, "word").alias(f"w{i}") for i in range(LONGEST)],
        *[of(use, j, "f").alias(f"{use}{j}") for use in "lr" for j in range(1, LONGEST)])
    cut = [F.when(F.col("k") > j, F.struct(F.expr(f"cast((cast(2000000 as decimal(20,0)) * a) div (cast(l{j} as decimal(20,0)) + r{j}) as bigint)").alias("score"),
                                           F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))) for j in range(1, LONGEST)]
    return got.withColumn("best", F.least(*cut)).select(
        "k", *KEYS, "lang", F.concat_ws(" ", *[f"w{i}" for i in range(LONGEST)]).alias("phrase"), "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer phrase mostly explains."""
    words, phrases = count_phrases(docs, text_col, lang_col, least, LONGEST, shards)
    longer = phrases.where("k > 2").withColumnRenamed("n", "f")
    inner = _each_length(longer, lambda k: [_part("s", i, i, n) for n in range(2, k) for i in range(k - n + 1)])
    most = inner.groupBy("part.pk", *[f"part.p{i}" for i in range(LONGEST)]).agg(F.max("f").alias("most")).toDF("k", *KEYS, "most")
    scored = scored_phrases(words, phrases, least).join(most, ["k", *KEYS], "left")
    stay = scored.where(F.expr("most is null or 100 * cast(most as decimal(20,0)) < 80 * cast(a as decimal(20,0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = stay.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]') AS parts
  FROM documents),
piece AS (SELECT lang, doc, unnest(parts) AS piece, generate_subscripts(parts, 1) AS nr FROM pieces),
split AS (SELECT lang, doc, nr, list_filter(string_split_regex(piece, '[ \t]'), lambda w: w <> '') AS ws FROM piece),
word AS (SELECT lang, doc, nr, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4
  FROM word WINDOW p AS (PARTITION BY doc, nr ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM ahead GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_part AS (
  SELECT lang, a AS f, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2)))
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase,
       b.a, b.l, b.r, t.n, b.score::BIGINT AS score
FROM best b JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = b.lang
LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM inner_part GROUP BY ALL) x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * b.a
QUALIFY rank <= 2000
"""
