"""LM scoring by masked pseudo-likelihood.

A small bidirectional network predicts every token of a text from the ``SIDE`` tokens before it and the
``SIDE`` after it; a document's score is the sum of the logarithms of these probabilities. Tokens are the
``VOCABULARY`` most frequent words of the corpus (counted over all documents) and, for all other words,
``RARE`` hashed classes; places beyond the text are a padding token. The output is a softmax in two steps,
over classes of tokens and over the tokens of a class, so a probability costs far less than one
over the whole vocabulary and still sums to one. A word outside the vocabulary has the probability of its
class times its share of the class, from the counts over all documents, so every word of the corpus is
predicted as itself: the shares of the ``KNOWN`` most frequent of these words are sent to the tasks, those
of all others joined.

Every place of every document trains, in each of ``ROUNDS`` rounds. The tokens are written once, two bytes each, dealt
by a hash of their slice, and in each round every partition improves the shared weights by mini-batch gradient descent in numpy on all its
places, those of a slice in a fixed random order; the weights of a round are the mean over partitions, weighted by
places, summed by Spark. A mini-batch has ``BATCH`` places, and up to ``LARGEST_BATCH`` once a partition has seen
many more. Weights, vocabulary and so what is sent to executors have one size at any input.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows score alike; an empty
table gives no rows; where there is nothing to train on, the untrained network scores; other columns
are ignored. Scores depend on the order of partial sums only in the last digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import textbytes as tb
from topicweave.llm.tables import written

VOCABULARY = 960
RARE = 63
TOKENS = 1 + VOCABULARY + RARE  # token 0 pads
CLASSES = 32
MEMBERS = TOKENS // CLASSES
KNOWN = 1 << 16
SIDE = 2
DIM = 16
HIDDEN = 32
ROUNDS = 3
BATCH = 512
LARGEST_BATCH = 4096
RATE = 0.5
HELD = 1 << 20  # words that a task counts at once
SLICE = 1 << 17  # bytes of text whose words a task holds at once
UNUSED = 1 << 15  # marks a written token as context only


def token_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the lower-cased words of a slice."""
    low = tb.lower_table().take(data)
    starts, ends = tb.runs((~tb.space_table()).take(low), offsets)
    return tb.owner(starts, offsets), tb.span_hash(tb.prefix_hash(low), starts, ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word bigint, n) over all texts; counted inside a task first, ``HELD`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        held, size = [np.zeros(0, np.uint64)], 0
        for b in batches:
            for _, data, offs in tb.text_slices(b.column(0), SLICE):
                held.append(token_words(data, offs)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield counted()
                    held, size = [np.zeros(0, np.uint64)], 0
        yield counted()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the most frequent words in order; ties by hash."""
    return most_frequent(word_counts(docs), size)


def most_frequent(counts: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


class Tokens:
    """Maps word hashes to tokens."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.token = words[order], order + 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = 1 + VOCABULARY + (h % np.uint64(RARE)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, self.token[at], out)
        return out


def rest_shares(counts: DataFrame, words: np.ndarray) -> DataFrame:
    """(word, n, log_share) of the words outside the vocabulary: log P(word | its class), from counts of the corpus."""
    shipped = counts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shipped.value)
        for b in batches:
            token = tokens(b.column(0).to_numpy().view(np.uint64))
            rest = pa.array(token > VOCABULARY)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(rest), b.column(1).filter(rest), pa.array(token).filter(rest)], names=["word", "n", "token"])

    rest = counts.select("word", "n").mapInArrow(run, "word bigint, n bigint, token bigint")
    totals = rest.groupBy("token").agg(F.sum("n").alias("total"))  # a row for each class
    return rest.join(F.broadcast(totals), "token").selectExpr("word", "n", "ln(n / total) as log_share")


def padded(doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with ``SIDE`` zeros before, between and after their texts, and the place of each."""
    text = np.cumsum(np.append(0, doc[1:] != doc[:-1])) if len(doc) else np.zeros(1, np.int64)  # texts without words leave no trace
    row = np.zeros(len(doc) + SIDE * (int(text[-1]) + 2), token.dtype)
    place = np.arange(len(doc)) + SIDE * (text[: len(doc)] + 1)
    row[place] = token
    return row, place


def windows(doc: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The 2 * SIDE neighbours of each token; 0 beyond the text."""
    row, place = padded(doc, token)
    return np.stack([row.take(place + step) for step in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


class Network:
    """Embeddings, one hidden layer, and the two output layers; weights are one flat vector."""

    SHAPES = [("embed", (TOKENS, DIM)), ("w1", (2 * SIDE * DIM, HIDDEN)), ("b1", (HIDDEN,)), ("wc", (CLASSES, HIDDEN)), ("bc", (CLASSES,)), ("wm", (CLASSES, MEMBERS, HIDDEN)), ("bm", (CLASSES, MEMBERS))]
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, self.room, at = flat, {}, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE, np.float32))
        net.embed[:] = rng.normal(0, 0.1, net.embed.shape)
        net.w1[:] = rng.normal(0, (2 * SIDE * DIM) ** -0.5, net.w1.shape)
        return net

    def _room(self, name: str, rows: int, *shape: int) -> np.ndarray:
        """An array that the next call may use again."""
        if name not in self.room or len(self.room[name]) < rows:
            self.room[name] = np.empty((rows, *shape), self.flat.dtype)
        return self.room[name][:rows]

    @staticmethod
    def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """An order in which targets of one class are neighbours, their classes, and where each class stands."""
        group = (target % CLASSES).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        group = group.take(order)
        cut = np.searchsorted(group, np.arange(CLASSES + 1, dtype=np.uint16)).tolist()
        return order, group, [(g, slice(cut[g], cut[g + 1])) for g in range(CLASSES) if cut[g] < cut[g + 1]]

    def _forward(self, context: np.ndarray, group: np.ndarray, parts: list[tuple[int, slice]]) -> tuple[np.ndarray, ...]:
        """Inputs, hidden layer, and the outputs over classes and over members of each row's class; rows stand by class."""
        n = len(context)
        x = np.take(self.embed, context, axis=0, out=self._room("x", n, 2 * SIDE, DIM), mode="clip").reshape(n, -1)
        h = np.dot(x, self.w1, out=self._room("h", n, HIDDEN))
        h += self.b1
        np.tanh(h, out=h)
        z = np.dot(h, self.wc.T, out=self._room("z", n, CLASSES))
        z += self.bc
        m = self._room("m", n, MEMBERS)
        for g, rows in parts:
            np.dot(h[rows], self.wm[g].T, out=m[rows])
        m += self.bm.take(group, axis=0)
        # |h| <= 1 bounds the outputs; only where exp could pass a float are they shifted
        if max((np.abs(w).sum(-1) + np.abs(b)).max() for w, b in ((self.wc, self.bc), (self.wm, self.bm))) > 80:
            z -= z.max(1, keepdims=True)
            m -= m.max(1, keepdims=True)
        return x, h, z, m

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(token | neighbours): frequent tokens are spread over all classes."""
        order, group, parts = self._by_class(target)
        chosen, rows = target.take(order), np.arange(len(target))
        _, _, z, m = self._forward(context.take(order, axis=0), group, parts)
        found = z[rows, chosen % CLASSES] + m[rows, chosen // CLASSES]
        found -= np.log((np.exp(z, out=z) @ np.ones(CLASSES, z.dtype)) * (np.exp(m, out=m) @ np.ones(MEMBERS, m.dtype)))
        out = np.empty(len(target), found.dtype)
        out[order] = found
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability."""
        n = len(target)
        order, group, parts = self._by_class(target)
        context, target, rows, ones = context.take(order, axis=0).astype(np.intp), target.take(order).astype(np.intp), np.arange(n), np.ones(n, self.flat.dtype)
        x, h, z, m = self._forward(context, group, parts)
        for p, chosen in ((z, target % CLASSES), (m, target // CLASSES)):
            np.exp(p, out=p)
            p *= (1 / (p @ np.ones(p.shape[1], p.dtype)))[:, None]
            p[rows, chosen] -= 1
        dh = np.dot(z, self.wc, out=self._room("dh", n, HIDDEN))
        back, gain_wm, gain_bm = self._room("back", n, HIDDEN), np.zeros_like(self.wm), np.zeros_like(self.bm)
        for g, own in parts:
            np.dot(m[own], self.wm[g], out=back[own])
            np.dot(m[own].T, h[own], out=gain_wm[g])
            np.dot(ones[own], m[own], out=gain_bm[g])
        dh += back
        gains = [(self.wm, gain_wm), (self.bm, gain_bm), (self.wc, z.T @ h), (self.bc, ones @ z)]
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        dh *= h
        dx = np.dot(dh, self.w1.T, out=self._room("dx", n, 2 * SIDE * DIM)).reshape(-1, DIM)
        gains += [(self.w1, x.T @ dh), (self.b1, ones @ dh)]
        flat = context.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat.take(order)
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        dx = np.take(dx, order, axis=0, out=self._room("by_token", len(flat), DIM), mode="clip")
        pairs = dx.view(np.result_type(dx, np.complex64))  # two cells to a sum
        self.embed[flat[heads]] -= rate / n * np.add.reduceat(pairs, heads).view(dx.dtype)
        for weight, gain in gains:
            gain *= rate / n
            weight -= gain


def training_tokens(docs: DataFrame, words: np.ndarray, share: float = 1.0) -> DataFrame:
    """(deal, packed): a number to deal rows by, and the tokens of a slice as 16-bit numbers, with ``SIDE`` zeros before, between and after its texts. Below a
    ``share`` of 1, the places that are not to be trained on carry ``UNUSED``."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shipped.value)
        for b in batches:
            for _, data, offs in tb.text_slices(b.column(0)):
                doc, h = token_words(data, offs)
                if not len(doc):
                    continue
                token = tokens(h).astype(np.uint16)
                if share < 1:
                    # the draw depends on the word, its place and the text's length alone, so reruns agree
                    place = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.uint64)
                    draw = tb.mix(h ^ tb.mix(place + np.uint64(1)) ^ np.diff(offs)[doc].astype(np.uint64))
                    token[(draw >> np.uint64(11)).astype(np.float64) >= share * 2.0**53] |= UNUSED
                row = padded(doc, token)[0]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(row)], pa.int64()), pa.array([row.tobytes()], pa.binary())], names=["deal", "packed"])

    return docs.select("text").mapInArrow(run, "deal bigint, packed binary")


def training_windows(packed: bytes) -> np.ndarray:
    """The neighbours and the token of every place to be trained on, in a fixed random order."""
    row = np.frombuffer(packed, np.uint16)
    at = np.flatnonzero((row > 0) & (row < UNUSED))
    at = at[np.random.default_rng(len(row)).permutation(len(at))]
    row = row & np.uint16(UNUSED - 1)
    return np.column_stack([row[at + step] for step in (*range(-SIDE, 0), *range(1, SIDE + 1), 0)])


def train(parts: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Rounds of local descent and averaging, each over all places of ``parts``: rows of packed tokens, in partitions."""
    net = Network.fresh()
    spark = parts.sparkSession
    for k in range(rounds):
        shipped = spark.sparkContext.broadcast(net.flat)
        pace = rate / (1 + k)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, pace=pace) -> Iterator[pa.RecordBatch]:
            local, seen = Network(shipped.value.copy()), 0
            rest = np.zeros((0, 2 * SIDE + 1), np.uint16)
            for b in batches:
                for packed in b.column(0):
                    rest = np.concatenate([rest, training_windows(packed.as_py())])
                    while len(rest) >= (size := min(max(BATCH, seen // 128), LARGEST_BATCH)):
                        local.step(rest[:size, :-1], rest[:size, -1], pace)
                        seen, rest = seen + size, rest[size:]
            if len(rest):
                local.step(rest[:, :-1], rest[:, -1], pace * min(len(rest) / BATCH, 1))
                seen += len(rest)
            if seen:
                cells = np.append(local.flat.astype(np.float64) * seen, float(seen))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "value"])

        sums = parts.select("packed").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        shipped.unpersist()
        if not sums.num_rows:
            return net
        flat = np.zeros(Network.SIZE + 1)
        flat[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
        net = Network((flat[:-1] / flat[-1]).astype(np.float32))
    return net


def score(docs: DataFrame, words: np.ndarray, net: Network, shares: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, log_likelihood, per_token) of every row, over whole texts; without ``shares``, words
    outside the vocabulary count as their classes only."""
    known = np.zeros(0, np.uint64), np.zeros(0)
    if shares is not None:
        top = shares.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
        h = top.column("word").to_numpy().view(np.uint64)
        known = h[np.argsort(h)], top.column("log_share").to_numpy()[np.argsort(h)]
    shipped = docs.sparkSession.sparkContext.broadcast((words, net.flat, *known))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, net = Tokens(shipped.value[0]), Network(shipped.value[1])
        known, log_share = shipped.value[2:]
        for b in batches:
            for row, data, offs in tb.text_slices(b.column(1), SLICE):
                doc, h = token_words(data, offs)
                token, logs = tokens(h), np.zeros(len(doc))
                around = windows(doc, token)
                for k in range(0, len(doc), 2048):
                    at = slice(k, k + 2048)
                    logs[at] = net.log_probability(around[at], token[at])
                tail = np.zeros(0, np.int64)
                if len(known):
                    rest = np.flatnonzero(token > VOCABULARY)
                    near = np.minimum(np.searchsorted(known, h[rest]), len(known) - 1)
                    hit = known[near] == h[rest]
                    logs[rest[hit]] += log_share[near[hit]]
                    tail = rest[~hit]
                docs_here = len(offs) - 1
                n = np.bincount(doc, minlength=docs_here)
                total = np.bincount(doc, logs, docs_here).astype(np.float64)
                cut = np.append(0, np.cumsum(np.bincount(doc[tail], minlength=docs_here))).astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(cut), pa.array(h[tail].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, docs_here), b.column(2).slice(row, docs_here), pa.array(n.astype(np.int64)), pa.array(total), tails],
                                                 names=["id", "content_key", "n_tokens", "log_likelihood", "tail"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content_key"))
    scored = rows.mapInArrow(run, f"id {kind}, content_key bigint, n_tokens bigint, log_likelihood double, tail array<bigint>")
    if shares is not None:
        # the words that no task knows: once for each different text, with as many repeats as it has
        scored = written(scored, "scored")
        tails = scored.where("size(tail) > 0").dropDuplicates(["content_key"]).select("content_key", F.explode("tail").alias("word"))
        sums = tails.join(shares.select("word", "log_share"), "word").groupBy("content_key").agg(F.sum("log_share").alias("more"))
        scored = scored.drop("tail").join(sums, "content_key", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return scored.select("id", "n_tokens", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1))).alias("per_token"))


def lm_scores(docs: DataFrame, share: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """Train on the whole corpus (or a ``share`` of its places), then score every row of it."""
    counts = written(word_counts(docs), "word-counts")
    words = most_frequent(counts)
    shares = written(rest_shares(counts, words), "rest-shares")
    parts = written(training_tokens(docs, words, share).repartition("deal").sortWithinPartitions("deal"), "training-tokens")
    return score(docs, words, train(parts, rounds), shares)
