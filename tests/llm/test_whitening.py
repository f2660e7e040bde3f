import math
import random

import numpy as np
import pytest

from topicweave.llm import whitening as W
from topicweave.llm.queries import QUERIES


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def brute(rows, components=16):
    """{(id, place)}: exact n, deviation; eigenvalues and |projections| by numpy."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[float(n * v - t) / n for v, t in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    dev = {i: sum((n * a - t) ** 2 for a, t in zip(x, s)) for i, x in kept}
    proj = {i: np.array([float(n * a - t) / n for a, t in zip(x, s)]) @ v / np.sqrt(np.maximum(e, 1e-300)) for i, x in kept}
    return n, dev, e / (centred**2).sum() * n, proj


def check(got, rows, components=16):
    n, dev, explained, proj = brute(rows, components)
    assert {(r.id, r.component) for r in got} == {(i, k + 1) for i in dev for k in range(len(explained))}
    sign = {}
    for r in got:
        assert (r.n, r.deviation) == (n, dev[r.id]) and r.identity_error <= 1e-9
        k = r.component - 1
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        want = proj[r.id][k]
        if abs(want) > 1e-6:
            assert sign.setdefault(k, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)


def test_equals_numpy_with_dropped_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, [3, 2, 1.5, 1, 0.7, 0.5])]) for i in range(120)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(600, None), (601, [1.0] * 5 + [None]), (602, [math.nan] * 6), (603, [math.inf] + [0.0] * 5)]
    table = vectors(spark, rows + [(604, []), (605, [1.0, 2.0])]).selectExpr("*", "1 as x", "2 as id", "3 as n").repartition(3)
    check(W.whiten(table).collect(), rows)
    assert len({r.component for r in W.whiten(table, components=2).collect()}) == 2


def test_rank_and_multiple_roots(spark):
    # the third entry repeats the first: the rank is 2; a square's two directions have the same eigenvalue
    rows = [(1, [1.0, 0.0, 1.0]), (2, [-1.0, 0.0, -1.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0])]
    got = W.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-12 for r in got)
    square = [(k, [float(x), float(y)]) for k, (x, y) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    got = W.whiten(vectors(spark, square)).collect()
    assert {round(r.explained, 12) for r in got} == {0.5} and all(r.identity_error < 1e-12 for r in got)
    for i in range(4):  # any two orthogonal directions of the plane will do
        assert sum(r.whitened**2 for r in got if r.id == i) == pytest.approx(2)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, [1e15, 1.0, 1e9])]) for i in range(40)]
    n, total, a = W.scatter(W.integer_vectors(vectors(spark, rows), "vec_id", "embedding").select("x").distinct(), 3)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert n == 40 and total == [sum(c) for c in zip(*xs)]
    for i in range(3):
        for j in range(3):
            assert a[i, j] == n * sum(x[i] * x[j] for x in xs) - total[i] * total[j]
    got = W.whiten(vectors(spark, rows)).collect()
    assert len(got) == 120 and all(r.deviation is None and r.identity_error < 1e-6 for r in got)


def test_empty_and_constant_tables(spark):
    assert W.whiten(vectors(spark, [])).collect() == []
    assert W.whiten(vectors(spark, [(1, None)])).collect() == []
    assert W.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(vectors(spark, [])).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def exact_polynomial(a):
    """Faddeev-LeVerrier in Python integers: coefficients, constant first."""
    d = len(a)
    m, out = [[0] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(a[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(am[i][i] for i in range(d)) // k)
    return out[::-1]


def test_polynomial_against_leverrier(spark):
    rng = random.Random(2)
    for d in (1, 2, 3, 6):
        b = [[rng.randint(-(10**6), 10**6) if rng.random() < 0.7 else 0 for _ in range(d)] for _ in range(d)]
        a = [[b[i][j] + b[j][i] for j in range(d)] for i in range(d)]
        table = np.array(a, object)
        primes = W.primes_for(W.coefficient_bound(table))
        found = [(p, W.polynomial_modulo(np.array([[v % p for v in r] for r in a], np.int64), p)) for p in primes]
        assert W.remaindered(found, d) == exact_polynomial(a)
    assert W.characteristic_polynomial(spark, table) == exact_polynomial(a)


def test_roots_are_counted_and_isolated():
    # (x - 1)(x - 4)^2 (x - 9) x
    poly = [0, -144, 232, -105, 18, -1]
    poly = [-v for v in poly]
    assert [W.roots_above(poly, m, 0) for m in (-1, 0, 1, 3, 4, 8, 9)] == [5, 4, 3, 3, 1, 1, 0]
    assert W.roots_above(poly, 35, 2) == 1 and W.roots_above(poly, 37, 2) == 0
    assert [(round(m / 2**s, 9), k) for m, s, k in W.largest_roots(poly, 4, 16)] == [(9, 1), (4, 2), (1, 1)]
    assert [(round(m / 2**s, 9), k) for m, s, k in W.largest_roots(poly, 2, 16)] == [(9, 1), (4, 2)]


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").withColumnRenamed("vec_id", "id").collect()
    check(got, rows)
