"""PCA whitening of embeddings from the exact characteristic polynomial of their scatter.

1. Entries become integers, ``floor(64 * c) + 1000000``. Their different vectors are the fit list.
2. The scatter of the fit list is summed exactly: entries less an integer close to their mean, so that
   products stay small, then corrected for the rest of the mean. n squared times the covariance is an
   integer matrix A = n * sum(z z') - (sum z)(sum z)'.
3. A's characteristic polynomial is computed modulo as many primes as a bound on its coefficients asks
   for, each by Hessenberg reduction (one Spark task takes a few primes), and put together by Chinese
   remaindering.
4. A is symmetric, so all roots are real, and the sign changes of the polynomial shifted to t count the
   roots above t, exactly and with their multiplicity. Bisection on that count isolates the largest
   roots; single roots are then refined by the polynomial's sign alone.
5. Each root's unit eigenvectors are found by inverse iteration on the null space of A - root * I, in
   decimal arithmetic of well over 100 digits; a multiple root gets as many orthogonal ones. Their largest
   entry is positive.
6. Every row is centred with the integers ``n * x - S``, projected and divided by sqrt(eigenvalue).

The driver holds a few d x d matrices (d: the vectors' length), never rows.

Defined results: rows whose vector is null or empty, or has a null or non-finite entry or one of 2**54 or more in size
(its integer may not fit) are dropped, as are vectors of another length than the commonest one (of equally common lengths
the longer); repeated rows and ids are each returned and count once in the fit; null ids are allowed;
components with eigenvalue 0 are not returned, so a fit list of one vector, or an empty table, gives no
rows; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.tables import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK = 2048  # vectors multiplied at a time
GUARD_BITS = 160  # roots are refined to 2**-160 of the largest one
ROUNDS = 3  # of inverse iteration


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<bigint>) of the rows that remain."""
    c = F.col(f"`{vector_col}`")
    most = float(1 << 60) / SCALE
    fine = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < most))  # false for NaN and infinities too
    kept = rows.where(c.isNotNull() & (F.size(c) > 0)).where(F.coalesce(fine, F.lit(False)))
    ints = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("bigint") + SHIFT)
    return kept.select(F.col(f"`{id_col}`").alias("id"), ints.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of integer matrices as Python integers: in doubles where no sum can pass 2**53, else in 24-bit limbs."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most * most * max(len(a), 1) < 1 << 53:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    low, high = (1 << 24) - 1, 24
    parts = [(a & low, b & low, 0), (a & low, b >> high, high), (a >> high, b & low, high), (a >> high, b >> high, 2 * high)]
    return sum(exact_product_small(u, v) << shift for u, v, shift in parts)


def exact_product_small(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``exact_product`` over rows in groups small enough for 64-bit sums, or over Python integers."""
    most = max(int(np.abs(a).max(initial=1)), int(np.abs(b).max(initial=1)))
    group = (1 << 53) // (most * most)
    if group < 1:
        return a.T.astype(object) @ b.astype(object)
    out = np.zeros((a.shape[1], b.shape[1]), object)
    for k in range(0, len(a), group):
        out = out + (a[k : k + group].T.astype(np.float64) @ b[k : k + group].astype(np.float64)).astype(np.int64).astype(object)
    return out


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, A): the fit list's size, its sums, and n squared times its covariance, as Python integers."""
    big = "decimal(38,0)"
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast(big)).cast(big).alias("s")).collect()
    n = sums[0]["n"]
    total = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    pivot = np.array([s // n for s in total], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d), object)
        for b in batches:
            z = _matrix(b.column(0), d) - pivot
            for k in range(0, len(z), BLOCK):
                out = out + exact_product(z[k : k + BLOCK], z[k : k + BLOCK])
        i, j = (x.astype(np.int32) for x in np.triu_indices(d))
        values, limb = out[i, j], 0
        while limb == 0 or (values != 0).any():  # limbs of 48 bits, so that no sum of them overflows
            low = values if limb == 3 else values & ((1 << 48) - 1)
            cells = [pa.array(i), pa.array(j), pa.array(np.full(len(i), limb, np.int32)), pa.array([Decimal(int(v)) for v in low], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "limb", "v"])
            values, limb = (values - low) >> 48, limb + 1

    cells = fit.select("x").mapInArrow(run, f"i int, j int, limb int, v {big}").groupBy("i", "j", "limb").agg(F.sum("v").cast(big).alias("v")).collect()
    rest = [s - n * int(p) for s, p in zip(total, pivot)]
    products = np.zeros((d, d), object)
    for r in cells:
        products[r["i"], r["j"]] += int(r["v"]) << (48 * r["limb"])
    a = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            a[i, j] = a[j, i] = n * products[i, j] - rest[i] * rest[j]
    return n, total, a


def _is_prime(p: int) -> bool:
    """Miller-Rabin with bases that settle every number below 2**32."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The primes below 2**31, from the top, whose product passes twice ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def coefficient_bound(a: np.ndarray) -> int:
    """No coefficient of the polynomial is larger: they are sums of products of at most d eigenvalues, each
    within the largest row sum."""
    return (1 + max(sum(abs(int(v)) for v in row) for row in a)) ** len(a)


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(x I - A) modulo the prime ``p``, A given modulo p: Hessenberg form by
    similar eliminations, then the recurrence over its leading minors."""
    h, d = a.copy(), len(a)
    for m in range(1, d - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        i = m + int(found[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    minors = [np.zeros(d + 1, np.int64) for _ in range(d + 1)]
    minors[0][0] = 1
    for m in range(1, d + 1):
        minors[m][1:] = minors[m - 1][:-1]
        minors[m] = (minors[m] - h[m - 1, m - 1] * minors[m - 1]) % p
        chain = 1
        for k in range(1, m):
            chain = chain * int(h[m - k, m - k - 1]) % p
            if not chain:
                break
            minors[m] = (minors[m] - chain * int(h[m - k - 1, m - 1]) % p * minors[m - k - 1]) % p
    return minors[d].tolist()


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """Coefficients (constant first) of det(x I - A), one Spark task for a few primes each."""
    primes, d = primes_for(coefficient_bound(a)), len(a)
    flat = [int(v) for v in a.ravel()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                got = polynomial_modulo(np.array([v % p for v in flat], np.int64).reshape(d, d), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([got], pa.list_(pa.int64()))], names=["p", "residues"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism), "p")
    return remaindered([(r["p"], r["residues"]) for r in dealt.mapInArrow(run, "p bigint, residues array<bigint>").collect()], d)


def remaindered(found: list[tuple[int, list[int]]], d: int) -> list[int]:
    """The integers of smallest size with the given residues."""
    whole = 1
    for p, _ in found:
        whole *= p
    out = [0] * (d + 1)
    for p, residues in found:
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        out = [v + unit * r for v, r in zip(out, residues)]
    return [v - whole if 2 * v > whole else v for v in (v % whole for v in out)]


def roots_above(poly: list[int], m: int, s: int) -> int:
    """How many roots (with multiplicity) exceed m / 2**s, for a polynomial of real roots: the sign changes
    of its Taylor expansion there."""
    d = len(poly) - 1
    c = [v << (s * (d - k)) for k, v in enumerate(poly)]  # roots times 2**s
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(poly: list[int], m: int, s: int) -> int:
    """The polynomial at m / 2**s, times 2**(s * degree)."""
    out, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        out = out * m + (poly[k] << (s * (d - k)))
    return out


def largest_roots(poly: list[int], count: int, top: int, bits: int = GUARD_BITS) -> list[tuple[int, int, int]]:
    """The ``count`` largest positive roots, falling, as (m, s, multiplicity): each lies within 2**-bits of
    ``top`` (a power of two above all roots) of m / 2**s. Roots closer than that count as one."""
    s = max(0, bits - top.bit_length() + 1)
    finest = max(0, top.bit_length() - 1 - bits)  # large roots: a unit is fine enough before 2**0
    out: list[tuple[int, int, int]] = []
    todo = [(0, top << s, roots_above(poly, 0, 0), 0)]  # (low, high], with the number of roots above either
    while todo and sum(x[2] for x in out) < count:
        low, high, above_low, above_high = todo.pop()
        held = above_low - above_high
        if not held:
            continue
        if held == 1:
            low, high = refined(poly, low, high, s, finest)
        if high - low <= 1 << finest:
            out.append((low + high, s + 1, held))
            continue
        mid = (low + high) // 2
        above = roots_above(poly, mid, s)
        todo += [(low, mid, above_low, above), (mid, high, above, above_high)]
    return out


def refined(poly: list[int], low: int, high: int, s: int, finest: int) -> tuple[int, int]:
    """(low, high] that holds one root, shrunk by the sign of the polynomial."""
    right = value_at(poly, high, s)
    if right == 0:
        return high - 1, high
    while high - low > 1 << finest:
        mid = (low + high) // 2
        v = value_at(poly, mid, s)
        if v == 0:
            return mid - 1, mid
        if (v > 0) == (right > 0):
            high = mid
        else:
            low = mid
    return low, high


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    d, x = len(lu), b[order].copy()
    for k in range(d):
        x[k + 1 :] = x[k + 1 :] - lu[k + 1 :, k] * x[k]
    for k in range(d - 1, -1, -1):
        x[k] = x[k] / lu[k, k]
        x[:k] = x[:k] - lu[:k, k] * x[k]
    return x


def null_vectors(a: np.ndarray, root: Decimal, count: int, digits: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors (Decimal) of the null space of A - root * I, by inverse iteration."""
    d = len(a)
    with decimal.localcontext() as ctx:
        ctx.prec = digits
        lu = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        for k in range(d):
            lu[k, k] -= root
        tiny = (abs(root) + 1) * Decimal(10) ** -(digits - 10)
        order = list(range(d))
        for k in range(d):  # elimination with row exchanges
            best = max(range(k, d), key=lambda i: abs(lu[i, k]))
            if best != k:
                lu[[k, best]] = lu[[best, k]]
                order[k], order[best] = order[best], order[k]
            if abs(lu[k, k]) < tiny:
                lu[k, k] = tiny
            lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
            lu[k + 1 :, k + 1 :] = lu[k + 1 :, k + 1 :] - np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
        rng = np.random.default_rng(d)  # fixed starts
        found = [np.array([Decimal(int(v)) for v in rng.integers(-1000, 1000, d)], object) for _ in range(count)]
        for _ in range(ROUNDS):
            base: list[np.ndarray] = []
            for v in found:
                v = _solved(lu, order, v)
                v = v / max(abs(x) for x in v)
                for _ in range(2):
                    for u in base:
                        v = v - u * (u @ v)
                base.append(v / (v @ v).sqrt())
            found = base
        return [v * (1 if v[int(np.argmax([abs(x) for x in v]))] > 0 else -1) for v in found]


def eigen(poly: list[int], a: np.ndarray, count: int) -> tuple[list[Decimal], list[np.ndarray]]:
    """The ``count`` largest positive eigenvalues of A, falling, with their unit eigenvectors."""
    top = 1 << int(max(sum(abs(int(v)) for v in row) for row in a)).bit_length()
    count = min(count, roots_above(poly, 0, 0))
    digits = 40 + 2 * len(str(top)) + int(GUARD_BITS * 0.61)
    values: list[Decimal] = []
    vectors: list[np.ndarray] = []
    for m, s, held in largest_roots(poly, count, top):
        with decimal.localcontext() as ctx:
            ctx.prec = digits
            root = Decimal(m) / (1 << s)
        values += [root] * held
        vectors += null_vectors(a, root, held, digits)
    return values[:count], vectors[:count]


def _whitened(x: np.ndarray, n: int, total: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, list]:
    """(whitened rows, exact deviations): centred with integers, rounded to doubles once."""
    if int(np.abs(x).max(initial=0)) * n < 1 << 62 and (np.abs(total) < 1 << 62).all():
        y = x * n - total.astype(np.int64)
    else:
        y = x.astype(object) * n - total
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        deviation = (y * y).sum(axis=1).tolist()
    else:
        y = y.astype(object)
        deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
    centred = y.astype(np.float64) / n if y.dtype != object else np.array([[float(Decimal(v) / n) for v in row] for row in y])
    return centred @ directions, deviation


def _identity_error(fit: DataFrame, d: int, n: int, total: np.ndarray, directions: np.ndarray) -> float:
    """The largest entry of the fit list's whitened covariance less the identity, as measured over its rows."""
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_wide = np.array(total, object)
        out = np.zeros((k, k))
        for b in batches:
            w, _ = _whitened(_matrix(b.column(0), d), n, total_wide, directions)
            out += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(out.ravel())], names=["cell", "v"])

    cells = fit.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    got = np.zeros(k * k)
    for r in cells:
        got[r["cell"]] = r["v"]
    return float(np.abs(got.reshape(k, k) / n - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    ints = integer_vectors(rows, id_col, vector_col)
    lengths = ints.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    ints = ints.where(F.size("x") == d)
    fit = written(ints.select("x").distinct(), "fit-list")
    n, total, a = scatter(fit, d)
    poly = characteristic_polynomial(spark, a)
    values, vectors = eigen(poly, a, components)
    if not values:
        return spark.createDataFrame([], schema)
    trace = sum(int(a[i, i]) for i in range(d))
    explained = np.array([float(e / trace) for e in values])
    # an eigenvalue of the covariance is one of A over n squared
    with decimal.localcontext() as ctx:
        ctx.prec = 60
        directions = np.array([[float(x * n / e.sqrt()) for x in v] for e, v in zip(values, vectors)]).T
    error = _identity_error(fit, d, n, total, directions)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_wide = np.array(total, object)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                w, deviation = _whitened(_matrix(part.column(1), d), n, total_wide, directions)
                rows_ = len(w)
                again = pa.array(np.repeat(np.arange(rows_), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * k, n)),
                    pa.array(deviation, pa.int64()).take(again), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return ints.mapInArrow(run, schema)
