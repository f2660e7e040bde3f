"""Toxicity, quality and language operators against plain re-computations over small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from topicweave.llm import language, quality, toxicity
from topicweave.llm import queries as Q
from topicweave.llm import textbytes as tb

from .test_classifiers import held

SF = "/root/testdata/sf0.001"


def test_quality_equals_gaussian_densities_by_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stats = {r.id: np.array(r.stats) for r in quality.document_statistics(docs).collect()}
    own = {c: np.array([stats[i] for i, y in labels.items() if y == c and not held(i) and i in stats]) for c in (0, 1)}
    n = {c: len(x) for c, x in own.items()}
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    cov = {c: np.cov(x.T, bias=True) for c, x in own.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    want = {}
    for i, x in stats.items():
        logs = {}
        for c in (0, 1):
            s = (1 - quality.SHRINK - quality.DIAGONAL) * cov[c] + quality.SHRINK * pooled + quality.DIAGONAL * np.diag(np.diag(pooled) + 1e-6) + 1e-9 * np.eye(len(x))
            gap = x - own[c].mean(0)
            logs[c] = -0.5 * gap @ np.linalg.solve(s, gap) - 0.5 * np.linalg.slogdet(s)[1]
        want[i] = 1 / (1 + math.exp(-max(-500, min(500, logs[1] - logs[0] + math.log(prior / (1 - prior))))))
    got = {r.doc_id: r.score for r in Q.op5_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)


def letters(text):
    return b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()))


def test_language_equals_a_loop_over_zstandard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    pieces, seen = defaultdict(list), Counter()
    for r in sorted(docs, key=lambda r: r.h):
        if held(r.doc_id) or r.lang is None or r.text is None:
            continue
        seen[r.lang] += 1
        if seen[r.lang] <= language.SAMPLE:
            at = r.h % max(len(r.text) - language.PIECE + 1, 1)
            pieces[r.lang].append(letters(r.text[at : at + language.PIECE]))
    content = {lang: b" ".join(p for p in found if p)[: language.DICTIONARY] for lang, found in pieces.items()}
    assert content == language.dictionaries(spark.read.parquet(f"{SF}/documents.parquet"))
    order = sorted(content, key=lambda x: (-seen[x], x))
    params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=zstandard.STRATEGY_GREEDY,
                                                 format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

    packers = {lang: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for lang in order}

    def size(raw, lang):
        n = math.ceil(len(raw) / language.SPAN)
        return sum(len(packers[lang].compress(raw[len(raw) * k // n : len(raw) * (k + 1) // n])) for k in range(n))

    got = {r.doc_id: r.lang_pred for r in Q.op6_language(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id] == "und"
            continue
        raw = letters(r.text) or r.text.encode()
        assert got[r.doc_id] == min(order, key=lambda lang: (size(raw, lang), order.index(lang))), r.doc_id


def plain_model(texts):
    """Kneser-Ney tables of both classes over dictionaries; every pair stands in passages of its own here, so a count is a
    number of documents."""
    pairs, words = [Counter(), Counter()], [Counter(), Counter()]
    for text, label in texts:
        ws = re.findall(r"[a-z0-9]+", text.lower())
        pairs[label].update(set(zip([None, *ws[:-1]], ws)))
        words[label].update(set(ws))

    def discount(counts):
        c = Counter(min(v, 5) for v in counts.values())
        y = c[1] / max(c[1] + 2 * c[2], 1)
        d = [k - (k + 1) * y * c[k + 1] / c[k] if c[k] else k / 2 for k in (1, 2, 3)]
        return [0.0] + [min(max(x, 0.05 * k), 0.95 * k) for k, x in zip((1, 2, 3), d)]

    def firm(a, b, size):
        z2 = (b - a) ** 2 / max(a + b, 1)
        return z2**2 / (z2**2 + (2 * math.log(max(2, size))) ** 2)

    slots = 1 << toxicity.WORD_BITS
    whole = sum(words[0].values()) + sum(words[1].values())
    shared = lambda w: (words[0][w] + words[1][w] + 0.5) / (whole + 0.5 * slots)
    out = []
    for c in (0, 1):
        # a pair that only the other class has counts 0 here, which takes part in no count of counts
        dp, dw = discount(pairs[c]), discount(words[c])
        total, freed = Counter(), Counter()
        for (v, _), n in pairs[c].items():
            total[v] += n
            freed[v] += dp[min(n, 3)]
        off, sum_words = sum(dw[min(n, 3)] for n in words[c].values()), sum(words[c].values())
        low = lambda w, c=c, dw=dw, off=off, s=sum_words: (words[c][w] - dw[min(words[c][w], 3)] + (off + 1) * shared(w)) / (s + 1)
        out.append((dp, total, freed, low))
    n_pairs, n_words = len(set(pairs[0]) | set(pairs[1])), len(set(words[0]) | set(words[1]))

    def difference(text):
        ws, diffs = re.findall(r"[a-z0-9]+", text.lower()), []
        for v, w in zip([None, *ws[:-1]], ws):
            logs, known = [], (v, w) in pairs[0] or (v, w) in pairs[1]
            for c, (dp, total, freed, low) in enumerate(out):
                n = pairs[c][v, w]
                logs.append(math.log((n - dp[min(n, 3)] + freed[v] * low(w)) / total[v] if total[v] else low(w)))
            alone = math.log(out[1][3](w) / out[0][3](w))
            d = alone * firm(words[0][w], words[1][w], n_words) + (logs[1] - logs[0] - alone) * known * firm(pairs[0][v, w], pairs[1][v, w], n_pairs)
            diffs.append(max(-toxicity.CLIP, min(toxicity.CLIP, d)))
        best = max(sum(diffs[i : i + toxicity.STRETCH]) / toxicity.STRETCH for i in range(len(diffs)))
        return sum(diffs) / len(diffs), best

    return difference


def test_toxicity_features_equal_kneser_ney_over_dictionaries(spark, make_docs):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary + ["nasty", "vile"] * (6 * (i % 2))) for _ in range(rng.randint(20, 60)))) for i in range(240)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in rows], "doc_id bigint, toxic int, quality int")
    part = {r.doc_id: (r.label, r.part) for r in toxicity.training_sample(labels, "toxic", toxicity.SAMPLE)[0].collect()}
    difference = plain_model([(t, part[i][0]) for i, t in rows if i in part and part[i][1] == 0])
    model = toxicity.fit(docs, labels)
    tests = [t for _, t in rows[:40]] + ["nasty w1 unseen words here", "w1", "vile nasty"]
    got = np.concatenate([model.features(d, o) for _, d, o in tb.text_slices(pa.array(tests))])
    want = np.array([difference(t) for t in tests])
    assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(model.score(got), 1 / (1 + np.exp(-(model.curve[0] + want @ model.curve[1:]))), atol=1e-3)
