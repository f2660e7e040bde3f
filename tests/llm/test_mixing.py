import hashlib
import math
import re

import pytest

from topicweave.llm import mixing as M


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, live = sum(sizes.values()), {}, set(names)
    while live:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = {s for s in live if share[s] > cap * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * sizes[s]
        live -= over
    return target


def check(docs):
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sums = {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + size(r.text)
    want = brute_targets(sums)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == sums[r.source]
        assert math.isclose(r.mix_target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        rate = r.mix_target / r.mix_source_size if r.mix_source_size else 1.0
        u = int(hashlib.md5(f"mix:{M.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.mix_copies == math.floor(rate) + (u < rate - math.floor(rate)) <= 3
    return got


def test_small_sources_stop_at_their_cap(make_docs):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}") for i in range(300)] + [(900 + i, "big " * 400, "en", "zz") for i in range(60)]
    got = check(make_docs(rows))
    assert any(math.isclose(r.mix_target, 3 * r.mix_source_size) for r in got) and any(r.mix_copies < 2 for r in got)


def test_edges(make_docs):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "one\x0btwo\tthree", "en", None), (4, "x " * 500_000, "en", "Ä"), (4, "nb sp", "en", "a"),
            (4, "nb sp", "en", "a"), (None, "no id", "en", "\U0001f642"), (5, "y", "en", "￮")]
    check(make_docs(rows).selectExpr("*", "1 as size", "2 as rate", "3 as target", "4 as src"))
    assert M.mix(make_docs(rows).limit(0)).count() == 0
    check(make_docs([(1, None), (2, "")]))


def test_emit_repeats_whole_documents(make_docs):
    docs = make_docs([(i, "a b c", "en", f"s{i % 3}") for i in range(90)])
    copies = {r.doc_id: r.mix_copies for r in M.mix(docs).collect()}
    out = M.emit(docs)
    assert out.columns == [*docs.columns, "copy"]
    seen = {}
    for r in out.collect():
        seen.setdefault(r.doc_id, []).append(r.copy)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(1, n + 1)) for k, n in copies.items() if n}


def test_no_python_in_the_plan(make_docs):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        M.mix(make_docs([(1, "a")])).explain("formatted")
    assert not re.search(r"PythonUDF|EvalPython|InPandas|InArrow|CartesianProduct|NestedLoop", text.getvalue())


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_taken_words_come_near_the_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    mixed = M.mix(docs)
    taken = mixed.selectExpr("sum(mix_size * mix_copies) t", "sum(mix_size) s").first()
    assert abs(taken.t / taken.s - 1) < 0.25
