"""Whitening against numpy's eigenvectors, and its exact parts against plain integer arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from semtflow.llm.common import table
from semtflow.llm.whitening import characteristic_polynomial, distinct_vectors, joined, largest_roots, null_spaces, primes_below, roots_above, scatter, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component int"


def leverrier(m):
    """Coefficients by the Faddeev-LeVerrier recurrence in fractions."""
    d = len(m)
    out, b = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        b = m @ b + out[-1] * np.eye(d, dtype=int).astype(object)
        c = Fraction(-int(np.trace(m @ b)), k)
        assert c.denominator == 1
        out.append(int(c))
    return out


def brute(rows, most=16):
    """Per remaining id: n, deviation, and whitened values from numpy, components as they fall."""
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in map(float, v)]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array([[n * c - t for c, t in zip(v, s, strict=True)] for v in fit], float) / n
    e, vec = np.linalg.eigh(x.T @ x / n)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(most, int((e > e[0] * 1e-9).sum()))
    out = {}
    for i, v in kept:
        exact = [n * c - t for c, t in zip(v, s, strict=True)]
        out[i, tuple(v)] = (n, sum(c * c for c in exact), np.array(exact, float) / n @ vec[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum())
    return out


def compared(rows, got):
    want = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == {i for i, _ in want}
    k = len(next(iter(want.values()))[3])
    signs = None
    for (i, _), (n, deviation, whitened, explained) in want.items():
        assert set(by[i]) == set(range(1, k + 1))
        mine = [by[i][c][0] for c in range(1, k + 1)]
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        np.testing.assert_allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in mine)
        ours = np.array([r.whitened for r in mine])
        signs = np.sign(ours * whitened) if signs is None else np.where(np.abs(whitened) > 1e-6, np.sign(ours * whitened), signs) if i == 0 else signs
        np.testing.assert_allclose(np.abs(ours), np.abs(whitened), atol=1e-8)
    return by


def test_given_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    got = whiten(e).collect()
    assert len(got) == 16 * len(rows)
    compared(rows, got)


def test_awkward_embeddings(spark):
    """Null vectors, null and non-finite entries go; copies weigh once; other lengths go; names clash."""
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.standard_normal(5) * (1, 2, 3, 4, 5)]) for i in range(60)]
    rows = good + [(100 + i, good[0][1]) for i in range(80)]
    bad = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [1.0, float("nan"), 1.0, 1.0, 1.0]), (303, [float("inf")] * 5)]
    short = [(304, []), (305, [1.0, 2.0]), (306, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows + bad + short], SCHEMA).repartition(7)
    got = whiten(df).collect()
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {60}
    compared(rows + bad, got)


def test_no_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "", 0), (2, [1.0, 2.0], 0, 0, "", 0), (3, None, 0, 0, "", 0)], SCHEMA)
    assert whiten(one).collect() == [] and whiten(one.limit(0)).collect() == [] and whiten(one.filter("vec_id = 3")).collect() == []


def test_equal_eigenvalues_and_rank(spark):
    """A cross: two equal eigenvalues, one of 0; the covariance of what comes out is the identity."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0])]
    got = whiten(spark.createDataFrame([(i, v, 0, 0, "", 0) for i, v in rows], SCHEMA)).collect()
    y = np.zeros((4, 2))
    for r in got:
        y[r.vec_id - 1, r.component - 1] = r.whitened
    np.testing.assert_allclose(y.T @ y / 4, np.eye(2), atol=1e-12)
    assert {r.explained for r in got} == {0.5} and len(got) == 8


def test_wide_entries(spark):
    """Entries of very different size: products beyond 64 bits stay exact."""
    rows = [(i, [float(1 << 30) * (i % 3), float(i), 0.25 * (i % 2)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 0, 0, "", 0) for i, v in rows], SCHEMA)
    s = scatter(distinct_vectors(df), 3)
    x = [[int(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [[12 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(3)] for i in range(3)]
    assert s.n == 12 and s.sums == sums and s.matrix.tolist() == want
    got = whiten(df.unionAll(spark.createDataFrame([(99, [1e300, -1e300, 0.0], 0, 0, "", 0)], SCHEMA.replace("float", "double")).select(df.columns))).collect()
    assert len(got) == 13 * 3 and {r.deviation is None for r in got} == {True, False} or len(got) == 13 * 3


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_polynomial(spark, d):
    """Also where pivots vanish and eigenvalues repeat."""
    rng = np.random.default_rng(d)
    a = rng.integers(-50, 50, (d, d + 2))
    cases = [a @ a.T, np.diag(rng.integers(0, 4, d)), np.kron(np.eye(d, dtype=int), np.ones((1, 1), int)) * 5]
    sparse = a[:, :1] @ a[:, :1].T
    for m in [*cases, sparse]:
        m = m.astype(object)
        assert characteristic_polynomial(spark, m) == leverrier(m)


def test_chinese_remainders():
    primes = primes_below(1 << 31, 9)
    assert primes[0] == (1 << 31) - 1 and all(pow(2, p - 1, p) == 1 for p in primes)
    for x in (0, 5, -5, 7**80, -(3**150)):
        assert joined([(p, x % p) for p in primes]) == x
    assert primes_below(30, 10) == [29, 23, 19, 17, 13, 11, 7, 5, 3, 2]


def test_roots():
    """Roots 1000, 7, 7, 1/2 is not whole: scaled to 2000, 14, 14, 1 and 0."""
    c = [1]
    for r in (2000, 14, 14, 1, 0):
        c = [a - r * b for a, b in zip([*c, 0], [0, *c], strict=True)]
    assert [roots_above(c, k, 0) for k in (2000, 1999, 14, 13, 1, 0, -1)] == [0, 1, 1, 3, 3, 4, 5]
    got = largest_roots(c, 5)
    assert [m for _, _, m in got] == [1, 2, 1]
    assert [round(num / 2**bits, 12) for num, bits, _ in got] == [2000.0, 14.0, 1.0]


def test_close_eigenvalues():
    """Two roots that differ in the thirteenth digit are told apart, and so are their spaces."""
    q = np.array([[3, 4], [-4, 3]], object)  # 25 times a rotation's square
    m = q @ np.diag(np.array([10**13, 10**13 + 1], object)) @ q.T
    d = [1, -int(m[0, 0] + m[1, 1]), int(m[0, 0] * m[1, 1] - m[0, 1] ** 2)]
    rows, _ = null_spaces(m, largest_roots(d, 2))
    np.testing.assert_allclose(np.abs(rows), [[0.8, 0.6], [0.6, 0.8]], atol=1e-4)
