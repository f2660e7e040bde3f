"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney bigram model of lower-cased letter runs.
A word's probability after another backs off to the class's counts of words, and those to
backoff counts that both classes share: the mass that the discounts free. Discounts are those of
modified Kneser-Ney, three for each class and order, from its counts of counts; every pair is kept.
The count of a pair or word is the number of different passages (``PASSAGE`` words on both sides) that hold it, at
most one a document, and texts are learned from once, so copies of a text or of a passage do not add up.
What a word, or a pair beyond its word, says for a class is weighed by how little chance explains its two
counts (``weights``); none is deleted. A document is described by the length-normalised
difference of the two log-likelihoods, over the whole text and over its best stretch of ``STRETCH``
words; a logistic curve, fitted on sample documents that the models have not counted, turns both
into a score.

Bounds: at most ``SAMPLE`` labelled documents per class are learned from (both classes the same
number, first by a hash of the id; whole texts). Word counts live in tables of 2**18 hashed words, pair
counts in one sorted list of the sample's pairs, so the model that is sent to the executors follows
the sample, not the input.

Defined results: null and empty texts get the score of a document without evidence; repeated rows
are scored alike; labels that are null, that contradict each other for an id, or whose id is held
out teach nothing; with no row of one class to learn from, every score is the (smoothed) share of
toxic labels; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import held_out, written

SAMPLE = 5000
WORD_BITS = 18
PASSAGE = 6  # words before and after a pair that tell its passages apart
STRETCH = 20
CLIP = 5.0  # nats: most that one word can say


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a slice: document, slot of the word before (0 opens a document), own slot."""
    low = tb.lower_table()[data]
    starts, ends = tb.runs(tb.letter_table()[low], offsets)
    doc = tb.owner(starts, offsets)
    word = (tb.span_hash(tb.prefix_hash(low), starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    before = np.zeros_like(word)
    if len(word):
        before[1:] = np.where(doc[1:] == doc[:-1], word[:-1], 0)
    return doc, before, word


def passages(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Per word, a hash of the words around the pair that it ends: ``PASSAGE`` on both sides, within the document."""
    h = np.zeros(len(word), np.uint64)
    for k in range(-PASSAGE - 1, PASSAGE + 1):
        there = np.arange(len(word)) + k
        ok = (there >= 0) & (there < len(word))
        there = np.clip(there, 0, max(len(word) - 1, 0))
        h = tb.mix(h + np.where(ok & (doc[there] == doc), word[there] + 1, 0).astype(np.uint64))
    return h


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney: what is taken from counts of 0, 1, 2, and 3 or more, from the counts of counts."""
    c = np.bincount(np.minimum(n.astype(np.int64), 5), minlength=6)[1:5].astype(float)
    y = c[0] / max(c[0] + 2 * c[1], 1.0)
    d = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in zip((1, 2, 3), d))])


def weights(counts: np.ndarray) -> np.ndarray:
    """From 0 to 1: a half where the squared deviation of the two counts from equality, in units of its variance,
    is what the most extreme of as many chance counts reaches (2 log of their number)."""
    z2 = (counts[1] - counts[0]) ** 2 / np.maximum(counts.sum(0), 1)
    bound = 2 * np.log(max(2, np.count_nonzero(counts.sum(0))))
    return (z2**2 / (z2**2 + bound**2)).astype(np.float32)


def discounted(n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what is left of the counts, what is taken)."""
    taken = d[np.minimum(n.astype(np.int64), 3)]
    return n - taken, taken


@dataclass
class Model:
    """Hashed Kneser-Ney tables of both classes (row 0 ordinary, row 1 toxic) and the logistic curve."""

    names: np.ndarray  # the pairs, sorted
    left: np.ndarray  # their counts less the discount, (2, pairs)
    firm: np.ndarray  # their weights
    totals: np.ndarray  # counts by the word before, (2, 2**WORD_BITS)
    freed: np.ndarray  # what the discounts take from them
    backoff: np.ndarray  # probability of a word, by class
    word_firm: np.ndarray  # weights of words
    curve: np.ndarray | None = None  # bias, whole-text and best-stretch weights
    prior: float = 0.5

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document: mean log-likelihood difference per word, and that of its best stretch."""
        docs = len(offsets) - 1
        doc, before, word = word_pairs(data, offsets)
        out = np.zeros((docs, 2))
        if not len(doc) or self.totals.shape[1] == 1:  # nothing to compare, or nothing learned
            return out
        logs = []
        name = (before << WORD_BITS) | word
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        known = self.names[at] == name
        for c in (0, 1):
            total, low = self.totals[c][before], self.backoff[c][word]
            seen = (self.left[c][at] * known + self.freed[c][before] * low) / np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, seen, low)))
        alone = np.log(self.backoff[1][word] / self.backoff[0][word])
        diff = np.clip(alone * self.word_firm[word] + (logs[1] - logs[0] - alone) * self.firm[at] * known, -CLIP, CLIP)
        run = np.append(0.0, np.cumsum(diff))
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        last = np.append(first[1:], len(doc))
        own = doc[first]
        out[own, 0] = (run[last] - run[first]) / (last - first)
        # a stretch begins at each word and is cut at the end of its document
        end = np.minimum(np.arange(len(doc)) + STRETCH, np.repeat(last, last - first))
        stretch = (run[end] - run[:-1]) / STRETCH
        out[own, 1] = np.maximum.reduceat(stretch, first)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(features), self.prior)
        z = self.curve[0] + features @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) to learn from: one row per id that is not held out and has one label, 0 or 1."""
    rows = labels.where(~held_out()).where(F.col(column).isin(0, 1)).groupBy("doc_id")
    return rows.agg(F.min(column).alias("label"), F.max(column).alias("most")).where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))


def training_sample(labels: DataFrame, column: str, sample: int) -> tuple[DataFrame | None, float]:
    """(doc_id, label, part) of at most ``sample`` ids per class, as many of each; part 1 (a quarter)
    fits the curve. Also the share of label 1; no sample where a class is missing."""
    rows = labelled(labels, column)
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return None, prior
    size = min(sample, *n.values())
    # the lowest hashes of a class lie below about size / n of their range: only rows below twice that,
    # and a thousand more, are ranked, so that no task gathers a class
    bound = {c: min((2 * size + 1000) * 2**64 // k, 2**64 - 1) - 2**63 for c, k in n.items()}
    low = rows.where(F.xxhash64("doc_id") <= F.when(F.col("label") == 0, F.lit(bound[0])).otherwise(F.lit(bound[1])))
    order = "row_number() over (partition by label order by xxhash64(doc_id), doc_id)"
    picked = low.selectExpr("*", f"{order} as nth").where(f"nth <= {size}")
    return written(picked.selectExpr("doc_id", "label", "case when nth % 4 = 0 then 1 else 0 end as part"), "training-sample"), prior


def _pair_counts(texts: DataFrame) -> DataFrame:
    """(name, n0, n1) of the fitting part: in how many different passages of each class a word pair (a word:
    the complement of its slot) stands, of those of one document the one with the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for row, data, offs in tb.text_slices(b.column(0)):
                doc, v, w = word_pairs(data, offs)
                name, around = np.concatenate([(v << WORD_BITS) | w, ~w]), np.tile(passages(doc, w).view(np.int64), 2)
                doc = np.tile(doc, 2)
                order = np.lexsort((around, name, doc))
                doc, name, around = doc[order], name[order], around[order]
                once = np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]))[: len(doc)]
                yield pa.RecordBatch.from_arrays([pa.array(name[once]), pa.array(label[row + doc[once]].astype(np.int32)), pa.array(around[once])], names=["name", "label", "around"])

    rows = texts.mapInArrow(run, "name bigint, label int, around bigint").distinct()
    return rows.groupBy("name").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of ``labels.<column>``, from a bounded sample of labelled documents."""
    picked, prior = training_sample(labels, column, sample)
    if picked is None:
        z = np.zeros((2, 1), np.float32)
        return Model(z[0], z, z[0], z, z, z, z[0], None, prior)
    # at most 2 * sample rows of three numbers: small at any input
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # each text once a class; one that is in both parts is counted and does not fit the curve
    texts = written(texts.groupBy("label", "text").agg(F.min("part").alias("part")).select("text", "label", "part"), "training-texts")
    got = _pair_counts(texts.where("part = 0").select("text", "label")).orderBy("name").toArrow()
    names, both = got.column("name").to_numpy(), np.array([got.column(c).to_numpy() for c in ("n0", "n1")])
    if not len(names):  # no words in the sample: one pair that nothing meets
        names, both = np.zeros(1, np.int64), np.zeros((2, 1), np.int64)
    n_words, size = int(np.searchsorted(names, 0)), 1 << WORD_BITS
    in_words = np.zeros((2, size), np.int64)
    in_words[:, ~names[:n_words]] = both[:, :n_words]
    names, in_pairs = names[n_words:], both[:, n_words:]
    before = names >> WORD_BITS
    left, totals, freed, backoff = [], [], [], []
    # the shared backoff has the shape of what both classes know of a word, over an even floor
    shared = (in_words.sum(0) + 0.5) / (in_words.sum() + 0.5 * size)
    for pairs, words in zip(in_pairs, in_words):
        rest, off = discounted(pairs, discounts(pairs))
        left.append(rest)
        totals.append(np.bincount(before, pairs, size))
        freed.append(np.bincount(before, off, size))
        rest, off = discounted(words, discounts(words))
        backoff.append((rest + (off.sum() + 1) * shared) / (words.sum() + 1))
    left, totals, freed, backoff = (np.array(x, np.float32) for x in (left, totals, freed, backoff))
    model = Model(names, left, weights(in_pairs), totals, freed, backoff, weights(in_words), None, prior)
    held = described(texts.where("part = 1").select(F.col("label").alias("id"), "text"), model).toArrow()
    y = held.column("id").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.column_stack([held.column("f0").to_numpy(), held.column("f1").to_numpy()])
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.curve = logistic(x, y, weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Bias and weights of a ridge logistic regression, by Newton steps on standardised columns."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(a.shape[1])
    pull = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (y - p)) - pull @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / sd).sum(), w[1:] / sd)


def described(rows: DataFrame, model: Model) -> DataFrame:
    """(id, f0, f1, score) of (id, text) rows, whole texts."""
    kind = rows.schema["id"].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shipped.value)
        for b in batches:
            parts = [model.features(data, offs) for _, data, offs in tb.text_slices(b.column(1))]
            f = np.concatenate(parts) if parts else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(model.score(f))], names=["id", "f0", "f1", "score"])

    return rows.mapInArrow(run, f"id {kind}, f0 double, f1 double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, score) of every row; a higher score: toxic likelier."""
    model = fit(docs, labels, "toxic", sample)
    return described(docs.select(F.col("doc_id").alias("id"), "text"), model).select("id", "score")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below ``threshold``, with their columns."""
    model = fit(docs, labels, "toxic", sample)
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shipped.value)
        for b in batches:
            parts = [model.features(data, offs) for _, data, offs in tb.text_slices(b.column(at))]
            if parts:
                yield b.filter(pa.array(model.score(np.concatenate(parts)) < threshold))

    return docs.mapInArrow(run, docs.schema)
