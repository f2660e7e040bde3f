import random
import re

import numpy as np
import pytest

from topicweave.llm import decontaminate as D


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_align(a, b):
    """Full table: (score, matches)."""
    best = (0, 0)
    h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s, m = h[i - 1][j - 1]
            cand = [(0, 0), (s + 2, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m)]
            cand += [(h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1])]
            h[i][j] = max(c for c in cand if c[0] >= 0)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(80):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 14))], np.uint64)
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 20))], np.uint64)
        score, matches, first, end = D.aligned(a, b)
        assert (score, matches) == brute_align(a.tolist(), b.tolist())
        assert score == 0 or D.align(a, b[first:end])[:2] == (score, matches)


def edit(rng, ws, share):
    out = []
    for w in ws:
        r = rng.random()
        if r < share / 3:
            continue
        out.append("changed%d" % rng.randint(0, 99) if r < share else w)
        if share < r < share * 4 / 3:
            out.append("added")
    return out


def corpus():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 60
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(16, 60)) for _ in range(30)]
    common = text(9)
    items[0][3:12] = common  # a run that half of the corpus holds
    docs = []
    for i in range(240):
        body = text(rng.randint(5, 200))
        if i % 2:
            body[2:2] = common
        if i % 4 == 0:
            ws = items[rng.randrange(30)]
            at = rng.randint(0, len(body))
            body[at:at] = edit(rng, ws, rng.choice([0, 0.05, 0.1, 0.3]))
        docs.append((i, " ".join(body).capitalize().replace(" word1 ", ", word1.\n")))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def test_equals_aligning_every_item_with_every_document(spark, make_docs):
    docs, items = corpus()
    got = {(r.id, r.item_id): r.similarity for r in D.alignments(make_docs(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for i, t in docs:
        ws = np.array([hash(w) for w in words(t)])
        for j, item in items:
            it = np.array([hash(w) for w in words(item)])
            _, m, _ = D.align(it, ws)
            if m >= 0.8 * len(it):
                want[i, j] = m / len(it)
    assert len(want) > 20 and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)  # a copy without five equal words in a row has no seed
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edges(spark, make_docs):
    item = " ".join(f"Item{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (4, ""), (5, "too short"), (None, item)], "item_id bigint, text string").selectExpr("*", "1 as words", "2 as gram")
    rows = [(1, item.upper()), (1, item.upper()), (1, "other text"), (2, None), (3, ""), (None, "before " + item + " after"), (4, "too short"), (5, "filler words " * 100_000 + item + (" x " + item) * 2)]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as item_id", "3 as gram", "4 as content_key")
    found = D.alignments(docs, items).collect()
    assert sorted(((r.id, r.item_id) for r in found), key=str) == sorted([(i, j) for i in (1, None, 5) for j in (1, 2)], key=str)
    assert {(r.first_word, r.end_word) for r in found if r.id is None} == {(1, 21)}
    left = D.without_benchmark(make_docs(rows), items)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in left.fillna("").collect()) == [(1, "other text"), (2, ""), (3, ""), (4, "too short")]
    assert D.alignments(docs.limit(0), items).count() == 0 and D.alignments(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_exact_copies_in_the_given_tables(spark, sf):
    docs, items = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
    texts = docs.collect()
    pairs = {(d.doc_id, b.item_id) for b in items.collect() for d in texts if b.text in (d.text or "")}
    got = {(r.id, r.item_id) for r in D.alignments(docs, items).collect()}
    assert pairs and pairs <= got


def test_a_copy_with_words_put_into_it_is_found_wherever_it_stands(spark, make_docs):
    item = [f"item{i}" for i in range(30)]
    rows, want = [], {}
    for at in range(30):
        # (words before the insertion, words inserted), one after another
        for cuts in ([(15, 20)], [(15, 25)], [(12, 16), (21, 16)], [(6, 9), (14, 13), (22, 11)]):
            ws = []
            for k, w in enumerate(item):
                ws += [f"new{k}x{j}" for c, n in cuts if c == k for j in range(n)] + [w]
            i = len(rows)
            rows.append((i, " ".join([f"a{j}" for j in range(at)] + ws + [f"z{j}" for j in range(40)])))
            want[i] = (at, at + len(ws))
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r.id: (r.first_word, r.end_word) for r in D.alignments(make_docs(rows), items).where("similarity = 1").collect()}
    assert got == want


def test_chained_starts():
    ids, lo, hi = [2, 1, 1, 1, 2], np.array([0, 70, 0, 35, 200]), np.array([5, 75, 8, 39, 210])
    assert list(D.spans(ids, lo, hi, np.full(5, 30))) == [(2, 0, 39), (1, 70, 75), (0, 0, 5), (4, 200, 210)]
