import random

import numpy as np
import pytest
import xxhash

from topicweave.llm import simhash as S


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fps = [(i, brute_fp(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = {}
    for k, (i, _) in enumerate(fps):
        ids = [fps[m][0] for m in range(len(fps)) if find(m) == find(k) and fps[m][0] is not None]
        out.setdefault(i, set()).add((fps[k][1], min(ids) if ids else None))
    return out


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "and", "Élan", "ça", "x", "Zed", "日本", "longer-word,", "a" * 40]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "two words"), (6, "a b c\x0bd")]
    for i in range(7, 120):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))))
    base = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    for i in range(120, 220):
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(900)] = f"n{rng.randint(0, 99)}"
        rows.append((i, " ".join(edited)))
    rows.append((500, "long " * 200_000))
    return rows


def test_xxh64_of_spans_equals_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 300)
    lens = np.concatenate([np.arange(0, 150), rng.integers(0, 200, 150)])
    got = S.xxh64_spans(data, starts, lens)
    raw = data.tobytes()
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[s : s + n], seed=42) for s, n in zip(starts, lens)]


@pytest.mark.parametrize("tile", [4, 2048])
def test_equals_brute_force(make_docs, tile):
    rows = corpus()
    got = {}
    for r in S.near_duplicates(make_docs(rows), tile=tile).collect():
        got.setdefault(r.id, set()).add((r.fp % (1 << 64), r.component))
    assert got == brute_components(rows)


def test_chain_of_links_is_one_component(spark):
    fps = [0]
    for k in range(20):
        fps.append(fps[-1] ^ (7 << (3 * k)))
    df = spark.createDataFrame([(f,) for f in fps + [(1 << 62) | 0xF0F0F0F0F0]], "fp bigint")
    from topicweave.llm.components import components

    got = {r.node: r.root for r in components(S.links(df, 3, tile=3)).collect()}
    assert {got[f] for f in fps} == {0}


def test_empty_repeated_null_ids_and_clashing_columns(make_docs):
    assert S.near_duplicates(make_docs([(1, "a")]).limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    docs = make_docs([(9, text), (9, text), (4, text), (None, text), (None, "alone " * 9), (7, "quite another text here")])
    clash = docs.selectExpr("*", "1 as fp", "2 as component", "3 as id")
    got = sorted(((r.id is None, r.id or 0, r.component) for r in S.near_duplicates(clash).collect()), key=str)
    assert got[:4] == [(False, 4, 4), (False, 7, 7), (False, 9, 4), (False, 9, 4)]
    assert got[4:] == [(True, 0, 4), (True, 0, None)]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "7", "None"]
