"""Quality by regularised quadratic discriminant analysis of document statistics.

Every whole text becomes a row of transformed statistics (logarithms of sizes, square roots of
shares). The class moments are sums over all labelled rows that may be learned from, taken by Spark
as an ordinary aggregate. Each class covariance is shrunk towards the pooled one and its
diagonal; its Cholesky factor is inverted once, and a score is the difference of the two Mahalanobis
log-densities with the classes' shares as prior, as a probability.

Defined results: null and empty texts are rows of zeros and are scored; repeated rows are scored
alike; labels that are null, contradictory or held out teach nothing; with fewer than two rows of
a class to learn from, every score is the (smoothed) share of label 1; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import written
from topicweave.llm.toxicity import labelled

SHRINK = 0.15  # share of the pooled covariance in a class covariance
DIAGONAL = 0.05  # share of the pooled variances
NAMES = ("words", "word_length", "longest_word", "symbols", "capitals", "digits", "marks", "calls", "bars", "other_bytes",
         "distinct_words", "same_as_before", "repeated_lines", "line_length", "repeated_triples", "wordless")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(part / np.maximum(whole, 1))


def distinct_per_doc(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Number of different hashes of each document."""
    if not len(doc):
        return np.zeros(docs, np.int64)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    return np.bincount(d[np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]))], minlength=docs)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document of a slice."""
    docs = len(offsets) - 1
    size = np.diff(offsets)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(mask))
        return run[offsets[1:]] - run[offsets[:-1]]

    table = tb.byte_table
    letters = per_doc(table(bytes(range(65, 91)) + bytes(range(97, 123)))[data])
    starts, ends = tb.runs(~tb.space_table()[data], offsets)
    doc, prefix = tb.owner(starts, offsets), tb.prefix_hash(data)
    h = tb.span_hash(prefix, starts, ends)
    words = np.bincount(doc, minlength=docs)
    length = np.bincount(doc, ends - starts, docs)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, ends - starts)
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) if len(doc) else doc
    good = np.append(0, np.cumsum(tb.letter_table()[data]))
    bare = doc[good[ends] == good[starts]]
    line_starts, line_ends = tb.runs(data != 10, offsets)
    line_doc = tb.owner(line_starts, offsets)
    lines = np.bincount(line_doc, minlength=docs)
    at = tb.pairs_within(doc, 3)
    triples = tb.triple_hash(h, at)
    n_triples = np.bincount(doc[at], minlength=docs)
    return np.column_stack([
        np.log1p(words), np.log1p(length / np.maximum(words, 1)), np.log1p(longest),
        _share(per_doc(table(b"#*$%&|<>~^_=+@\\{}[]")[data]), size), _share(per_doc(table(bytes(range(65, 91)))[data]), letters), _share(per_doc(table(b"0123456789")[data]), size),
        _share(per_doc(table(b".,;:?")[data]), size), _share(per_doc(table(b"!")[data]), size), _share(per_doc(table(b"|")[data]), size), _share(per_doc(data >= 128), size),
        _share(distinct_per_doc(doc, h, docs), words), _share(np.bincount(doc[same], minlength=docs), words),
        _share(lines - distinct_per_doc(line_doc, tb.span_hash(prefix, line_starts, line_ends), docs), lines), np.log1p(words / np.maximum(lines, 1)),
        _share(n_triples - distinct_per_doc(doc[at], triples, docs), n_triples), _share(np.bincount(bare, minlength=docs), words)])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(id, stats) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [statistics(data, offs) for _, data, offs in tb.text_slices(b.column(1))]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {kind}, stats array<double>")


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors and log-determinants, and the prior of label 1."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    logdet: np.ndarray | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.logdet)]
        z = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: count, sums and sums of products. The aggregate has d * (d + 3) / 2 + 1 rows a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(NAMES)
        i, j = np.triu_indices(d)
        total = np.zeros((2, 1 + d + len(i)))
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).values.to_numpy().reshape(-1, d) if b.num_rows else np.zeros((0, d))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own)[i, j]])
        c, k = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)), pa.array(total.ravel())], names=["label", "cell", "value"])

    cells = rows.mapInArrow(run, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    d = len(NAMES)
    i, j = np.triu_indices(d)
    out = {}
    for c in (0, 1):
        v = np.zeros(1 + d + len(i))
        for r in cells:
            if r.label == c:
                v[r.cell] = r.value
        products = np.zeros((d, d))
        products[i, j] = products[j, i] = v[1 + d :]
        out[c] = (v[0], v[1 : 1 + d], products)
    return out


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality", shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Discriminant:
    rows = stats.join(labelled(labels, column).withColumnRenamed("doc_id", "id"), "id").select("label", "stats")
    sums = moments(rows)
    n = np.array([sums[0][0], sums[1][0]])
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(None, None, None, prior)
    means = np.array([sums[c][1] / n[c] for c in (0, 1)])
    cov = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    floor = np.diag(np.diag(pooled) + 1e-6)
    whiten, logdet = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink - diagonal) * cov[c] + shrink * pooled + diagonal * floor + 1e-9 * np.eye(len(NAMES)))
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(logdet), prior)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, score) of every row; a higher score: good quality likelier."""
    stats = written(document_statistics(docs), "document-statistics")
    shipped = docs.sparkSession.sparkContext.broadcast(vars(fit(stats, labels)))
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Discriminant(**shipped.value)
        for b in batches:
            x = b.column(1).values.to_numpy().reshape(b.num_rows, len(NAMES)) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    return stats.mapInArrow(run, f"id {kind}, score double")
