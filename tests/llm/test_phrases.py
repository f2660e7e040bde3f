import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from topicweave.llm import phrases as P
from topicweave.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """The rule in plain Python: {lang: rows}, and the counts behind it."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = defaultdict(list)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                most[lang, ws[i : i + k]] = max(most[lang, ws[i : i + k]], a)
    for (lang, ws), a in cand.items():
        if 100 * most[lang, ws] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return {lang: [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(v)[:top])] for lang, v in out.items()}, f


def texts(rng, n):
    words = ["the", "The", "of", "öl", "日本", "x", "y", "z", "new", "york", "city", "a"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 30)):
            t += rng.choice(["new york city", "New York", "of the", rng.choice(words), rng.choice(words) + str(rng.randint(0, 40))]) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "])
        out.append((t, rng.choice(["en", "de", None, "und"])))
    return out + [("", "en"), (None, "en"), ("a b c d " * 40, None), ("W" * 300 + " " + "w" * 300, "en"), (" .,\n", "fr")]


def found(docs, **kw):
    out = defaultdict(list)
    for r in P.collocations(docs, **kw).collect():
        out[r["lang"]].append(tuple(r))
    return {lang: sorted(v, key=lambda x: x[1]) for lang, v in out.items()}


@pytest.mark.parametrize("least,top,shards", [(5, 2000, 2), (3, 7, 1)])
def test_equals_brute_force(spark, least, top, shards, monkeypatch):
    monkeypatch.setattr(P, "HELD", 50 if shards == 1 else 1 << 21)
    rows = texts(random.Random(least), 150)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string")
    docs = docs.selectExpr("*", "1 as shard", "2 as h1", "3 as k", "'w' as word", "4 as n").repartition(4)
    want, _ = brute(rows, least, top)
    assert found(docs, least=least, top=top, shards=shards) == want
    assert {len(p[2].split()) for v in want.values() for p in v} >= {2, 3}


def test_every_frequent_phrase_is_counted_and_a_scan_runs_several_lengths(spark, monkeypatch):
    seen, real = [], P._scan
    monkeypatch.setattr(P, "_scan", lambda shard, number, scan, words, maps, *a: seen.append((words, sorted(maps))) or real(shard, number, scan, words, maps, *a))
    monkeypatch.setattr(P, "LEAST_BITS", 6)  # crowded bitmaps: false bits cost rows, never counts
    monkeypatch.setattr(P, "MOST_BITS", 6)
    rows = texts(random.Random(8), 200)
    _, f = brute(rows, 4, 10)
    words, phrases = P.count_phrases(spark.createDataFrame(rows, "text string, lang string").repartition(5), least=4, shards=3)
    name = {r.h1: (r.lang, r.word) for r in words.collect()}
    assert Counter({(lang, (w,)): r.n for r in words.collect() for lang, w in [name[r.h1]]}) == Counter({p: a for p, a in f.items() if len(p[1]) == 1})
    got = {(name[r.h1][0], tuple(name[h][1] for h in (r.h1, r.h2, r.h3, r.h4)[: r.k])): r.n for r in phrases.collect()}
    assert got == {p: a for p, a in f.items() if len(p[1]) > 1 and a >= 4}
    assert any(words and maps for words, maps in seen) and any(len(maps) > 1 for _, maps in seen)


def test_words_that_share_a_hash_are_counted_again(spark, monkeypatch):
    real = P.word_places

    def colliding(column, langs, seed):
        for data, starts, stops, row, h, piece in real(column, langs, seed):
            yield data, starts, stops, row, (h % np.uint64(3) if seed == 0 else h), piece

    monkeypatch.setattr(P, "word_places", colliding)
    rows = [("a b c d. a b", "en")] * 5
    want, _ = brute(rows, 5, 10)
    assert found(spark.createDataFrame(rows, "text string, lang string"), least=5, top=10, shards=1) == want


def test_empty_table_and_big_counts(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(empty).collect() == []
    assert P.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    a, left, right = 3 * 10**13, 10**18, 9 * 10**17  # the products pass 64 bits
    words = spark.createDataFrame([(1, "en", "p", left), (2, "en", "q", right)], "h1 bigint, lang string, word string, n bigint")
    pairs = spark.createDataFrame([(2, 1, 2, 0, 0, a)], "k int, h1 bigint, h2 bigint, h3 bigint, h4 bigint, n bigint")
    row = P.scored_phrases(words, pairs).first()
    assert (row.phrase, row.l, row.r, row.score) == ("p q", left, right, 2_000_000 * a // (left + right))


def test_long_words_and_cut_out():
    data = pa.array(["ab  c", "x" * 600, None, "Z"])
    langs = np.zeros(4, np.uint64)
    words = [w for d, s, e, *_ in P.word_places(data, langs, 0) for w in P.cut_out(d, s, e).to_pylist()]
    assert words == ["ab", "c", "x" * 600, "z"]


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want, _ = brute([(r.text, r.lang) for r in docs], 30, 2000)
    got = QUERIES["op11_collocations"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(r for v in want.values() for r in v)
