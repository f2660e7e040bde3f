import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from topicweave.llm import repeats as R


def brute(texts, length):
    """Per text: removed bytes as a mask."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append((b, mask))
    return out


def digest(b, mask):
    runs = int(np.sum(mask & ~np.append(False, mask[:-1]))) if len(b) else 0
    kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
    return len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()


def corpus(rng, n, passage):
    words = ["the", "öl", "of", "日本", "brown", "fox\n", "x"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(k))
    shared = [text(passage) for _ in range(3)]
    out = []
    for _ in range(n):
        t = text(rng.randint(1, 40))
        for s in rng.sample(shared, rng.randint(0, 2)):
            t += s + text(rng.randint(0, 10))
        out.append(t)
    return out + [out[0], out[1][:-3] + "zzz", "ab" * 300, "z" * 500, "", None, " "]


@pytest.mark.parametrize("length,seed,group", [(40, 8, 1024), (40, 8, 3), (400, 64, 1024)])
def test_equals_brute_force(make_docs, length, seed, group):
    rng = random.Random(length + group)
    texts = corpus(rng, 60, 12 if length == 40 else 130)
    rows = list(enumerate(texts))
    docs = make_docs(rows).selectExpr("*", "1 as anchor", "2 as content", "3 as id", "4 as spans")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.removal_digest(docs, R.repeat_spans(docs, length=length, seed=seed, group=group)).collect()}
    assert got == {i: digest(b, m) for i, (b, m) in enumerate(brute(texts, length))}
    assert any(v[1] for v in got.values())


def test_random_strings_against_the_index():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([8, 9, 12, 20])
        base = bytes(rng.choice(b"ab") for _ in range(80))
        strings = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 40)
            s = bytearray(base[a : a + rng.randint(length, 60)])
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(len(s))] = rng.choice(b"abc")
            strings.append(bytes(s))
        strings += [b"a" * 50, b"\0\xff" * 20] if rng.random() < 0.3 else []
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        got = [[i for f, t in r for i in range(f, t + 1)] for r in R.marked_starts(strings, length)]
        assert got == want


def test_sliding_minimum_is_the_leftmost():
    rng = random.Random(1)
    for _ in range(40):
        h = np.array([rng.randint(0, 6) << 40 for _ in range(rng.randint(5, 90))], dtype=np.uint64)
        w = rng.randint(1, 5)
        assert R.sliding_min_place(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def test_repeated_ids_and_empty_table(make_docs):
    a, b = "left side " * 60, "another " * 70
    rows = [(1, a), (1, a), (2, "x" + b), (2, "short"), (None, b)]
    docs = make_docs(rows)
    got = sorted(((r.id, r.n_bytes, r.n_removed) for r in R.removal_digest(docs, R.repeat_spans(docs)).collect()), key=str)
    masks = brute([t for _, t in rows], 400)
    assert got == sorted(((i, len(t.encode()), int(m.sum())) for (i, t), (_, m) in zip(rows, masks)), key=str)
    none = docs.limit(0)
    assert R.removal_digest(none, R.repeat_spans(none)).count() == 0


def test_cut_text_is_valid_and_lost_documents_go(make_docs):
    passage = "é" * 250
    rows = [(1, "a clean text"), (2, "start " + passage + " end"), (3, passage), (4, "é" + passage), (5, ""), (6, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in R.without_repeats(make_docs(rows)).collect()}
    assert out[1] == ("a clean text", 12) and out[2] == ("start  end", 10)
    assert out[5] == ("", 0) and out[6] == (None, 0) and set(out) == {1, 2, 5, 6}


def test_suffix_order_and_least_match_against_brute_force():
    rng = random.Random(9)
    for trial in range(12):
        base = bytes(rng.choice(b"ab\x00\xff") for _ in range(60))
        strings = [base[rng.randrange(30) : 30 + rng.randrange(31)] * rng.choice((1, 1, 2)) for _ in range(rng.randrange(1, 6))]
        strings = [s + bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))) for s in strings]
        full, few = R.RunLengthIndex(strings, 10_000), R.RunLengthIndex(strings, 10_000, least=12)
        order = R.suffix_order(full.symbols, full.left)
        suffixes = [s[i:] for s in strings for i in range(len(s) + 1)]
        assert sorted(order.tolist()) == list(range(len(suffixes)))
        placed = [suffixes[i] for i in order.tolist()]
        assert placed == sorted(placed)

        def common(a, b):
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        want = [max([common(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]
        assert full.matching_statistics().tolist() == want
        got = few.matching_statistics().tolist()
        assert all(g == w if w >= 12 else g < 12 for g, w in zip(got, want))
