"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.llm.common import cut, stored

#: Grid steps of a unit, and what is added; entries beyond MOST steps count as MOST.
STEPS, SHIFT, MOST = 64, 1_000_000, 1 << 53
#: Components returned.
COMPONENTS = 16
#: Rows multiplied at a time; primes of a task; bits kept below the last root's width.
ROWS, PRIMES, BITS = 1 << 11, 16, 120
_LIMB = 20
_HALF = 1 << 62


# --- vectors on the grid --------------------------------------------------------


def _grid(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: the rows that count (no null or non-finite entry), their lengths, and
    their grid steps end to end. Entries that a double cannot hold apart are cut to MOST."""
    sizes = np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(float), nan=0.0).astype(np.int64)
    flat = col.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(sizes.size), sizes)
    bad = np.zeros(sizes.size, bool)
    bad[owner[~np.isfinite(values)]] = True
    bad |= np.asarray(col.is_null())
    keep = ~bad[owner]
    with np.errstate(over="ignore"):
        steps = np.clip(np.floor(values[keep] * STEPS), -MOST, MOST).astype(np.int64)
    rows = np.flatnonzero(~bad)
    return rows, sizes[rows], steps


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors meet as their grid steps in the narrowest integers that hold them."""
    for b in batches:
        _, sizes, steps = _grid(b.column("embedding"))
        ends = np.cumsum(sizes)
        out = set()
        for k, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
            x = steps[k : k + n]
            most = int(np.abs(x).max(initial=0))
            kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i8"
            out.add((n, x.astype(kind).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["size", "x"])


def _matrix(raw: list[bytes], d: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, f"<i{len(x) // d}").astype(np.int64) for x in raw]) if raw else np.zeros((0, d), np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed pieces of 20 bits, low first: their products and sums are exact in doubles."""
    out = []
    while True:
        low = ((x + (1 << _LIMB - 1)) & ((1 << _LIMB) - 1)) - (1 << _LIMB - 1)
        out.append(low.astype(float))
        x = (x - low) >> _LIMB
        if not x.any():
            return out


def _scattered(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)  # with a 1 in front: count, sums and products
        for b in batches:
            raw = b.column("x").to_pylist()
            for k in range(0, len(raw), ROWS):
                x = _matrix(raw[k : k + ROWS], d)
                x = np.concatenate([np.ones((x.shape[0], 1), np.int64), x], axis=1)
                parts = _limbs(x)
                for i, p in enumerate(parts):
                    for j, q in enumerate(parts):
                        total += (p.T @ q).astype(np.int64).astype(object) << _LIMB * (i + j)
        at = [(i, j, *divmod(int(total[i, j]), _HALF)) for i in range(d + 1) for j in range(i, d + 1) if total[i, j]]
        kind = pa.decimal128(38, 0)
        cols = [pa.array([r[c] for r in at], pa.int32()) for c in (0, 1)] + [pa.array([Decimal(r[c]) for r in at], kind) for c in (2, 3)]
        yield pa.RecordBatch.from_arrays(cols, ["i", "j", "high", "low"])

    return run


@dataclass
class Scatter:
    """n distinct vectors of d grid steps, their sums, and n times the sum of products less the product of sums."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def scatter(vectors: DataFrame, d: int) -> Scatter:
    """Exact integers; a cell of a task's sum travels in two halves, (d + 1)^2 cells in all."""
    cells = vectors.select("x").mapInArrow(_scattered(d), "i int, j int, high decimal(38,0), low decimal(38,0)")
    cells = cells.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    full = np.zeros((d + 1, d + 1), object)
    for r in cells:
        full[r.i, r.j] = full[r.j, r.i] = int(r.high) * _HALF + int(r.low)
    n, sums = int(full[0, 0]), full[0, 1:]
    return Scatter(n, [int(s) for s in sums], n * full[1:, 1:] - np.multiply.outer(sums, sums))


# --- the characteristic polynomial ------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The largest ``count`` primes under ``top`` (under 2^31), by a sieve over windows."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for p in range(2, 1 << 8):
        if small[p]:
            small[p * p :: p] = False
    out, hi = [], top
    while len(out) < count:
        lo = max(2, hi - (1 << 16))
        window = np.ones(hi - lo, bool)
        for p in np.flatnonzero(small).tolist():
            window[max(p * p, -(-lo // p) * p) - lo :: p] = False
        out += (lo + np.flatnonzero(window)[::-1]).tolist()
        hi = lo
    return out[:count]


def polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Characteristic polynomials, highest power first, of one matrix modulo each of many primes.

    ``a`` holds the residues, a matrix per prime. Similarity steps bring every matrix to
    Hessenberg form (pivots are chosen prime by prime); then determinants of the leading blocks
    follow from one another.
    """
    a = a.copy()
    count, d = a.shape[0], a.shape[1]
    each, mod = np.arange(count), p[:, None]
    for m in range(1, d - 1):
        pivot = m + np.argmax(a[:, m:, m - 1] != 0, axis=1)
        rows = a[each, pivot].copy()
        a[each, pivot] = a[:, m]
        a[:, m] = rows
        cols = a[each, :, pivot].copy()
        a[each, :, pivot] = a[:, :, m]
        a[:, :, m] = cols
        factor = a[:, m + 1 :, m - 1] * _inverse(a[:, m, m - 1], p)[:, None] % mod
        a[:, m + 1 :] = (a[:, m + 1 :] - factor[:, :, None] * a[:, None, m] % mod[:, :, None]) % mod[:, :, None]
        moved = np.zeros((count, d), np.int64)
        for k in range(factor.shape[1]):  # products stay under 2^62 and are reduced one by one
            moved = (moved + factor[:, k, None] * a[:, :, m + 1 + k]) % mod
        a[:, :, m] = (a[:, :, m] + moved) % mod
    block = np.zeros((d + 1, count, d + 1), np.int64)  # of the leading blocks, lowest power first
    block[0, :, 0] = 1
    for k in range(1, d + 1):
        out = np.zeros((count, d + 1), np.int64)
        out[:, 1:] = block[k - 1, :, :-1]
        out = (out - a[:, k - 1, k - 1, None] * block[k - 1]) % mod
        below = np.ones(count, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            out = (out - (a[:, i - 1, k - 1] * below % p)[:, None] * block[i - 1]) % mod
        block[k] = out
    return block[d][:, ::-1]


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x^(p-2) modulo p; 0 stays 0."""
    out, base, e = np.ones_like(x), x % p, p - 2
    while e.any():
        out = np.where(e & 1, out * base % p, out)
        base, e = base * base % p, e >> 1
    return out * (x % p != 0)


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients, highest power first, of an integer symmetric matrix without negative roots.

    Every task takes some primes; the residues, one per prime and coefficient, are joined by the
    Chinese remainder theorem. No coefficient exceeds (1 + trace)^d, which tells how many primes
    are enough.
    """
    d = matrix.shape[0]
    bound = 2 * (1 + sum(int(matrix[i, i]) for i in range(d))) ** d + 1
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 1)
    cells = [str(int(x)) for x in matrix.ravel()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [int(c) for c in cells]
        for b in batches:
            ps = b.column("p").to_pylist()
            for k in range(0, len(ps), PRIMES):
                part = ps[k : k + PRIMES]
                residues = np.array([[c % p for c in whole] for p in part], np.int64).reshape(-1, d, d)
                got = polynomials(residues, np.array(part, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(got.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(-(-len(primes) // PRIMES), spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks, "p")
    rows = [(r.p, r.c) for r in dealt.mapInArrow(run, "p long, c array<bigint>").collect()]
    return [joined([(p, c[k]) for p, c in rows]) for k in range(d + 1)]


def joined(residues: list[tuple[int, int]]) -> int:
    """The integer nearest to 0 with the given residues, by halves."""

    def both(lo: int, hi: int) -> tuple[int, int]:
        if hi - lo == 1:
            return residues[lo]
        (p, x), (q, y) = both(lo, (lo + hi) // 2), both((lo + hi) // 2, hi)
        return p * q, x + p * ((y - x) * pow(p, -1, q) % q)

    m, x = both(0, len(residues))
    return x - m if x > m // 2 else x


# --- its roots -------------------------------------------------------------------


def _shifted(c: list[int], num: int, bits: int) -> list[int]:
    """Coefficients, up to a positive factor, of the polynomial around num / 2^bits."""
    out = [x << bits * k for k, x in enumerate(c)]
    for last in range(len(c) - 1, 0, -1):
        for k in range(1, last + 1):
            out[k] += out[k - 1] * num
    return out


def roots_above(c: list[int], num: int, bits: int) -> int:
    """How many roots, with their multiplicity, exceed num / 2^bits.

    All roots are real, so the sign changes of the coefficients around a point (Budan) count
    exactly the roots to its right.
    """
    signs = [x > 0 for x in _shifted(c, num, bits) if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(c: list[int], num: int, bits: int) -> int:
    out = 0
    for k, x in enumerate(c):
        out = out * num + (x << bits * k)
    return out


def largest_roots(c: list[int], count: int) -> list[tuple[int, int, int]]:
    """(num, bits, multiplicity) of the largest positive roots, falling, ``count`` in all or a few more.

    Intervals are halved until they hold one root, or are so narrow beside their place (2^-BITS)
    that what they hold is one root of a higher multiplicity; single roots are then narrowed by
    signs alone. The root is the middle of its interval.
    """
    while len(c) > 1 and not c[-1]:
        c = c[:-1]  # roots at zero
    if len(c) < 2:
        return []
    top = 1 << max(1, abs(c[1]).bit_length())  # the sum of the roots is under it
    todo, out, got = [(0, top, 0, len(c) - 1)], [], 0  # open below, closed above, in units of 2^-bits
    while todo and got < count:
        lo, hi, bits, many = todo.pop()
        narrow = lo > 0 and (hi - lo) << BITS < hi
        if many == 1 and not narrow:
            lo, hi, bits = _narrowed(c, lo, hi, bits)
        if many == 1 or narrow:
            out.append((lo + hi, bits + 1, many))
            got += many
            continue
        if hi - lo == 1:
            lo, hi, bits = lo << 1, hi << 1, bits + 1
        mid = (lo + hi) // 2
        above = roots_above(c, mid, bits) - roots_above(c, hi, bits)
        if many - above:
            todo.append((lo, mid, bits, many - above))
        if above:
            todo.append((mid, hi, bits, above))
    return out


def _narrowed(c: list[int], lo: int, hi: int, bits: int) -> tuple[int, int, int]:
    """The interval of a single root, halved by signs until it is narrow."""
    up = _value(c, hi, bits)
    if not up:
        return (hi << BITS) - 1, (hi << BITS) + 1, bits + BITS
    while lo == 0 or (hi - lo) << BITS >= hi:
        if hi - lo == 1:
            lo, hi, bits = lo << 1, hi << 1, bits + 1
        mid = (lo + hi) // 2
        at = _value(c, mid, bits)
        if not at:
            return (mid << BITS) - 1, (mid << BITS) + 1, bits + BITS
        if (at > 0) == (up > 0):
            hi = mid
        else:
            lo = mid
    return lo, hi, bits


# --- components --------------------------------------------------------------------


def null_spaces(matrix: np.ndarray, roots: list[tuple[int, int, int]]) -> tuple[np.ndarray, list[int]]:
    """Unit eigenvectors as rows, and the root of each, by inverse iteration on matrix less root.

    Each block of a root's multiplicity is iterated together; then every vector is corrected
    with residuals of a longer mantissa. The entry of largest size is positive.
    """
    d = matrix.shape[0]
    unit = max(1, max(abs(int(x)) for x in matrix.ravel()))
    shift = max(0, unit.bit_length() - 62)
    long = np.array([[int(x) >> shift for x in row] for row in matrix], np.int64).astype(np.longdouble) if shift else matrix.astype(np.int64).astype(np.longdouble)
    scale = np.longdouble(unit >> shift)
    long = long / scale
    plain = long.astype(float)
    rows, of = np.zeros((0, d)), []
    start = np.random.default_rng(11).standard_normal((d, d))
    for k, (num, bits, many) in enumerate(roots):
        cut_bits = max(0, num.bit_length() - 62)
        value = np.ldexp(np.longdouble(num >> cut_bits), cut_bits - bits - shift) / scale
        near = plain - (float(value) * (1 + 2.0**-50) + 2.0**-70) * np.eye(d)
        x = start[:, :many]
        for _ in range(3):
            try:
                x = np.linalg.solve(near, x)
            except np.linalg.LinAlgError:
                x = np.linalg.solve(near - 2.0**-48 * np.eye(d), x)
            x = np.linalg.qr(x - rows.T @ (rows @ x))[0]
        if many == 1:
            x = _corrected(long, value, x[:, 0])[:, None]
        x = x.T * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None, :], 0)[0] < 0, -1, 1)[:, None]
        rows = np.concatenate([rows, x])
        of += [k] * many
    return rows, of


def _corrected(long: np.ndarray, value: np.longdouble, x: np.ndarray) -> np.ndarray:
    """Newton steps on (matrix - root) x = 0, x'x = 1, solved in doubles, residuals in long doubles."""
    d = x.size
    y = x.astype(np.longdouble)
    border = np.zeros((d + 1, d + 1))
    border[:d, :d] = (long - value * np.eye(d)).astype(float)
    border[:d, d] = border[d, :d] = x
    for _ in range(3):
        y = y / np.sqrt(y @ y)
        rest = (long @ y - value * y).astype(float)
        y = y - np.linalg.solve(border, np.append(rest, 0.0))[:d]
    y = y / np.sqrt(y @ y)
    return y.astype(float)


@dataclass
class Whitening:
    """n, sums (of grid steps), unit components as rows, eigenvalues and explained shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values, and the sum of squares of n x - S (null if no long holds it)."""
        most = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        exact = x.astype(object) * self.n - self.sums.astype(object) if most * most * max(1, x.shape[1]) >= 1 << 63 else x * self.n - self.sums.astype(np.int64)
        square = (exact * exact).sum(axis=1)
        deviation = [int(s) if s < 1 << 63 else None for s in square.tolist()]
        return (exact / self.n).astype(float) @ self.components.T / np.sqrt(self.eigenvalues), deviation


def fit(vectors: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct grid vectors (column x, as ``distinct_vectors`` gives them)."""
    s = scatter(vectors, d)
    trace = sum(int(s.matrix[i, i]) for i in range(d))
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, s.matrix), min(most, d)) if trace else []
    rows, of = null_spaces(s.matrix, roots)
    rows, of = rows[:most], of[:most]

    def ratio(k: int, by: int) -> float:
        num, bits, _ = roots[k]
        return num / (by << bits)

    return Whitening(s.n, np.array(s.sums, object), rows, np.array([ratio(k, s.n * s.n) for k in of]), np.array([ratio(k, trace) for k in of]))


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """size, x: every distinct vector once, as packed grid steps. Copies meet in partial aggregations."""
    return stored(embeddings.select("embedding").mapInArrow(_packed, "size int, x binary").distinct(), "vectors")


def _moments(w: Whitening, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.components.shape[0]
        total = np.zeros((k, k))
        for b in batches:
            raw = b.column("x").to_pylist()
            for i in range(0, len(raw), ROWS):
                y = w.project(_matrix(raw[i : i + ROWS], d))[0]  # centred: the sums are exact
                total += y.T @ y
        cells = [(i, j, total[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.float64())], ["i", "j", "v"])

    return run


def identity_error(vectors: DataFrame, d: int, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    if not w.components.shape[0]:
        return 0.0
    cells = vectors.select("x").mapInArrow(_moments(w, d), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r.v / w.n - (r.i == r.j)) for r in cells)


def _whitened(w: Whitening, d: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.components.shape[0]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                rows, sizes, steps = _grid(b.column("embedding"))
                mine = sizes == d
                steps = steps[np.repeat(mine, sizes)].reshape(-1, d) if d else np.zeros((0, 0), np.int64)
                values, deviation = w.project(steps)
                ids = b.column("vec_id").take(pa.array(np.repeat(rows[mine], k)))
                m = steps.shape[0]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), pa.array(deviation, pa.int64()).take(each),
                        pa.array(values.ravel()), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component.

    A vector counts if it is not null and holds no null or non-finite entry. Its entries become
    whole steps of 1/64; the fit takes each distinct vector of steps once, so repeated rows and
    hot copies weigh nothing more, and repeated or null ids do no harm. Where vectors differ in
    length, those of the commonest length (ties: the longest) among the distinct ones count,
    however long. Components of eigenvalue 0 are not returned, so a table of one distinct vector,
    of empty vectors, or none at all gives no rows; equal eigenvalues share their space in a
    fixed order. Steps beyond 2^53 are cut to it; a deviation that no long holds is null.
    Other columns are not read.

    What the driver sees is (d + 1)^2 sums and d + 1 coefficients per prime, whatever the rows.
    """
    vectors = distinct_vectors(embeddings)
    sizes = cut(vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n"))).orderBy(F.desc("n"), F.desc("size")).first()
    d = sizes["size"] if sizes else 0
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), kind)
    mine = vectors.filter(F.col("size") == d)
    w = fit(mine, d, most)
    return rows.mapInArrow(_whitened(w, d, identity_error(mine, d, w)), kind)
