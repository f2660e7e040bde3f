import random
from collections import Counter

import numpy as np

from topicweave.llm import lm_score as L


def test_probabilities_sum_to_one_and_follow_the_definition():
    net = L.Network.fresh(3)
    net.flat[:] += np.random.default_rng(1).normal(0, 0.2, len(net.flat)).astype(np.float32)
    context = np.array([[1, 2, 3, 4]])
    logs = np.array([net.log_probability(context, np.array([t]))[0] for t in range(L.TOKENS)])
    assert np.isclose(np.exp(logs).sum(), 1, atol=1e-4)
    h = np.tanh(net.embed[[1, 2, 3, 4]].reshape(-1) @ net.w1 + net.b1)
    t = 777
    a, b = net.wc @ h + net.bc, net.wm[t % L.CLASSES] @ h + net.bm[t % L.CLASSES]
    want = a[t % L.CLASSES] - np.log(np.exp(a).sum()) + b[t // L.CLASSES] - np.log(np.exp(b).sum())
    assert np.isclose(logs[t], want, atol=1e-4)


def test_a_step_follows_the_numeric_gradient():
    rng = np.random.default_rng(5)
    net = L.Network((rng.normal(0, 0.3, L.Network.SIZE)).astype(np.float64))
    context, target = rng.integers(0, L.TOKENS, (7, 2 * L.SIDE)), rng.integers(0, L.TOKENS, 7)
    before = net.flat.copy()
    net.step(context, target, 1.0)
    gain = before - net.flat
    for cell in [*rng.choice(np.flatnonzero(gain), 25), *np.argsort(-np.abs(gain))[:10]]:
        loss = []
        for e in (1e-5, -1e-5):
            moved = before.copy()
            moved[cell] += e
            loss.append(-L.Network(moved).log_probability(context, target).mean())
        assert np.isclose(gain[cell], (loss[0] - loss[1]) / 2e-5, rtol=1e-3, atol=1e-7)


def brute(text, words, net):
    ws = (text or "").encode().lower().split()
    from topicweave.llm import textbytes as tb

    toks = []
    for w in ws:
        a = np.frombuffer(w, np.uint8)
        h = tb.span_hash(tb.prefix_hash(a), np.array([0]), np.array([len(a)]))[0]
        hit = np.flatnonzero(words == h)
        toks.append(int(hit[0]) + 1 if len(hit) else 1 + L.VOCABULARY + int(h % np.uint64(L.RARE)))
    pad = [0] * L.SIDE + toks + [0] * L.SIDE
    total = 0.0
    for i, t in enumerate(toks):
        around = pad[i : i + L.SIDE] + pad[i + L.SIDE + 1 : i + 2 * L.SIDE + 1]
        total += net.log_probability(np.array([around]), np.array([t]))[0]
    return len(toks), total


def test_scores_equal_brute_force_on_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "one"), (4, "The cat sat\ton the\x0bmat ünï"), (4, "the cat"), (4, "the cat"), (None, "no id here"), (5, "long text " * 60_000)]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as n_tokens", "3 as word", "4 as deal")
    words, net = L.vocabulary(docs), L.Network.fresh(2)
    got = sorted(((r.id, r.n_tokens, round(r.log_likelihood, 2)) for r in L.score(docs, words, net).collect() if r.id != 5), key=str)
    assert got == sorted(((i, *(lambda n, s: (n, round(s, 2)))(*brute(t, words, net))) for i, t in rows if i != 5), key=str)
    none = docs.limit(0)
    assert L.lm_scores(none).count() == 0
    only_empty = L.lm_scores(make_docs([(1, None), (2, "")])).collect()
    assert {(r.id, r.n_tokens, r.log_likelihood) for r in only_empty} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_vocabulary_counts_all_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = Counter(w for r in docs.collect() for w in (r.text or "").encode().lower().split())
    got = sorted((r.n for r in L.word_counts(docs).collect()), reverse=True)
    assert got == sorted(want.values(), reverse=True)


def test_training_tells_order_from_noise(make_docs):
    rng = random.Random(1)
    nxt = {i: (i * 7 + 3) % 50 for i in range(50)}
    rows = []
    for i in range(300):
        w, ws = rng.randrange(50), []
        for _ in range(200):
            ws.append(f"w{w}")
            w = nxt[w]
        rows.append((i, " ".join(ws)))
    odd = [(1000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(200))) for i in range(20)]
    got = {r.id: r.per_token for r in L.lm_scores(make_docs(rows + odd), share=0.9, rounds=4).collect()}
    plain = np.array([got[i] for i in range(300)])
    mixed = np.array([got[1000 + i] for i in range(20)])
    assert plain.min() > mixed.max() + 0.5 and plain.mean() > -3.0


def test_words_outside_the_vocabulary_are_predicted_as_themselves(make_docs, monkeypatch):
    monkeypatch.setattr(L, "KNOWN", 25)  # the others are joined
    frequent = " ".join(f"v{k} v{k} v{k} v{k}" for k in range(L.VOCABULARY))
    rows = [(i, frequent) for i in range(3)] + [(10, "odd odd odd v1 gibberish"), (10, "odd v1"), (11, "odd v1"), (None, "odd v1"), (12, None)]
    rows += [(20 + k, " ".join(f"r{j}" for j in range(k, 300, 7))) for k in range(7)] + [(30, "r1 r1 r2")]
    docs = make_docs(rows)
    counts, net = L.word_counts(docs), L.Network.fresh(2)
    words = L.most_frequent(counts)
    n = Counter(w for _, t in rows for w in (t or "").split())
    total = Counter()
    rest = {w for w in n if w[0] != "v"}
    from topicweave.llm import textbytes as tb

    def klass(w):
        a = np.frombuffer(w.encode(), np.uint8)
        return int(tb.span_hash(tb.prefix_hash(a), np.array([0]), np.array([len(a)]))[0] % np.uint64(L.RARE))

    for w in rest:
        total[klass(w)] += n[w]
    want = []
    for i, t in rows:
        k, s = brute(t, words, net) if i not in (0, 1, 2) else (0, 0)
        want.append((i, k, round(s + sum(np.log(n[w] / total[klass(w)]) for w in (t or "").split() if w in rest), 2)))
    got = L.score(docs, words, net, L.rest_shares(counts, words)).collect()
    assert sorted(((r.id, r.n_tokens, round(r.log_likelihood, 2)) for r in got if r.id not in (0, 1, 2)), key=str) == sorted((w for w in want if w[0] not in (0, 1, 2)), key=str)
    assert len(got) == len(rows)


def test_every_place_trains(make_docs):
    rows = [(i, " ".join(f"w{(i * j) % 90}" for j in range(i * 13 % 70))) for i in range(200)] + [(7, "w1"), (7, "w1"), (None, None), (8, "  ")]
    docs = make_docs(rows)
    words = L.vocabulary(docs)
    got = Counter()
    for r in L.training_tokens(docs, words).collect():
        got.update(map(tuple, L.training_windows(r.packed).tolist()))
    want, number = Counter(), {}
    for _, t in rows:
        for w in (t or "").split():
            if w not in number:
                a = np.frombuffer(w.encode(), np.uint8)
                number[w] = int(np.flatnonzero(words == L.tb.span_hash(L.tb.prefix_hash(a), np.array([0]), np.array([len(a)]))[0])[0]) + 1
        pad = [0] * L.SIDE
        toks = pad + [number[w] for w in (t or "").split()] + pad
        for i in range(L.SIDE, len(toks) - L.SIDE):
            want[(*toks[i - L.SIDE : i], *toks[i + 1 : i + L.SIDE + 1], toks[i])] += 1
    assert got == want and sum(want.values()) > 5000


def test_the_query_trains_on_all_places(make_docs, monkeypatch):
    seen = []
    train = L.train
    monkeypatch.setattr(L, "train", lambda parts, rounds: (seen.append(sum(len(L.training_windows(r.packed)) for r in parts.collect())), train(parts, rounds))[1])
    rows = [(i, "some words of a text " * (i + 1)) for i in range(30)]
    L.lm_scores(make_docs(rows))
    assert seen == [sum(5 * (i + 1) for i in range(30))]


def test_a_step_follows_the_definition_place_by_place():
    rng = np.random.default_rng(4)
    for scale, sizes in ((0.2, (40, 7, 300)), (9.0, (40, 90))):  # large weights: exp alone would pass a float
        net = L.Network(rng.normal(0, scale, L.Network.SIZE))
        for n in sizes:  # arrays of an earlier, larger step are used again
            context, target = rng.integers(0, L.TOKENS, (n, 2 * L.SIDE)), rng.integers(0, 70, n)
            old, want = L.Network(net.flat.copy()), net.flat.copy()
            gain = L.Network(np.zeros(L.Network.SIZE))
            for c, t in zip(context, target):
                x = old.embed[c].ravel()
                h = np.tanh(x @ old.w1 + old.b1)
                g, k = t % L.CLASSES, t // L.CLASSES
                z, m = old.wc @ h + old.bc, old.wm[g] @ h + old.bm[g]
                dz, dm = np.exp(z - z.max()), np.exp(m - m.max())
                dz, dm = dz / dz.sum(), dm / dm.sum()
                logs = np.log(dz[g]) + np.log(dm[k])
                assert np.isclose(old.log_probability(c[None], np.array([t]))[0], logs, rtol=1e-6, atol=1e-9)
                dz[g] -= 1
                dm[k] -= 1
                da = (dz @ old.wc + dm @ old.wm[g]) * (1 - h * h)
                gain.wc[:] += np.outer(dz, h)
                gain.bc[:] += dz
                gain.wm[g] += np.outer(dm, h)
                gain.bm[g] += dm
                gain.w1[:] += np.outer(x, da)
                gain.b1[:] += da
                np.add.at(gain.embed, c, (old.w1 @ da).reshape(-1, L.DIM))
            net.step(context, target, 0.3)
            assert np.allclose(net.flat, want - 0.3 / n * gain.flat, rtol=1e-9, atol=1e-9)


def test_a_task_counts_its_words_together(make_docs, monkeypatch):
    monkeypatch.setattr(L, "SLICE", 20, raising=False)
    docs = make_docs([(i, "a few words a few") for i in range(50)] + [(None, None)]).coalesce(1)
    batches, group_by = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda df, *a: batches.append(df.collect()) or group_by(df, *a))
    got = sorted(r.n for r in L.word_counts(docs).collect())
    assert got == [50, 100, 100]
    assert sorted(r.n for r in batches[0]) == [50, 100, 100]  # one row for each word, not one for each slice
    monkeypatch.setattr(L, "HELD", 7)
    assert sorted(r.n for r in L.word_counts(docs).collect()) == [50, 100, 100] and len(batches[1]) > 3
