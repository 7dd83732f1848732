"""Operator 11: whitening of embeddings by the exact characteristic polynomial."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, map_batches, saved, table

#: An entry c becomes floor(64 * c) + 1,000,000; components that are given.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Roots are parted and refined to this many bits below the trace; roots that agree in all of
#: them count as one of higher multiplicity. Digits of the inverse iteration.
ROOT_BITS, DIGITS = 160, 70
#: Sums travel in limbs of this many bits; products are made of smaller ones.
LIMB, LIMBS, SPLIT, ROWS = 30, 7, 21, 1024
_LONG = 1 << 63


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) as longs, at the ends of their range (less the offset) beyond it. The offset is left
    out, as covariances don't depend on it."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    most = float(_LONG >> 1)
    out = np.clip(scaled, -most, most - 1024).astype(np.int64)
    return out


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a batch's vectors, -1 for those that are null or hold a null or an entry
    that isn't finite; and the entries of the others, one after the other."""
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    lengths = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)  # nulls become nan
    row = np.repeat(np.arange(n), lengths)
    bad = np.bincount(row, ~np.isfinite(values), n) > 0
    lengths = np.where(bad | np.asarray(column.is_null()), -1, lengths)
    return lengths, values[~bad[row]]


def packed(df: DataFrame, vector_col: str) -> DataFrame:
    """length, packed: the whole numbers of each usable vector, in the least of 1, 2, 4 or 8 bytes
    that holds all of its entries, so that equal vectors are equal bytes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, values = _entries(batch.column(0))
        lengths = lengths[lengths > 0]
        x, out, at = whole(values), [], 0
        for length in lengths.tolist():
            own = x[at : at + length]
            at += length
            low, high = own.min(), own.max()
            for width in (1, 2, 4, 8):
                if width == 8 or (-(1 << (8 * width - 1)) <= low and high < 1 << (8 * width - 1)):
                    break
            out.append(own.astype(f"<i{width}").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int32)), pa.array(out, pa.binary())], ["length", "packed"])

    return map_batches(df.select(F.col(vector_col).cast("array<double>")), step, "length int, packed binary")


def unpacked(blobs: list[bytes], length: int) -> np.ndarray:
    out = np.empty((len(blobs), length), np.int64)
    for k, blob in enumerate(blobs):
        out[k] = np.frombuffer(blob, f"<i{len(blob) // length}")
    return out


def exact_products(x: np.ndarray) -> np.ndarray:
    """The matrix of exact sums of x_i * x_j over the rows. Entries are split into limbs
    so small that the sum of a block's products is exact in a double."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(x), ROWS):
        rest, parts = x[at : at + ROWS], []
        while True:
            low = ((rest + (1 << (SPLIT - 1))) & ((1 << SPLIT) - 1)) - (1 << (SPLIT - 1))
            parts.append(low.astype(np.float64))
            rest = (rest - low) >> SPLIT
            if not rest.any():
                break
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (SPLIT * (i + j)))
    return total


def _limbs(value: int) -> list[int]:
    out = [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, value >> (LIMB * (LIMBS - 1))]


@dataclass(frozen=True)
class Scatter:
    """n vectors of the fit list, their sums, and n * sum(x x') - S S' (n * n times the covariance)."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


def scatter_of(fit: DataFrame, length: int) -> Scatter:
    """Each task sums its rows in whole numbers; Spark adds the limbs of the sums. What
    reaches the driver is a number a pair of dimensions."""
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches):
        n, sums, products = 0, [0] * length, np.zeros((length, length), object)
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), length)
            n += len(x)
            sums = [a + sum(x[:, k].tolist()) for k, a in enumerate(sums)]
            products = products + exact_products(x)
        cells = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(sums)), *((i, j, products[i, j]) for i in range(length) for j in range(i + 1))]
        limbs = np.array([_limbs(int(value)) for _, _, value in cells], np.int64)
        ends = [pa.array([cell[k] for cell in cells], pa.int32()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, limbs.T.copy())], ["i", "j", *names])

    bounded_batches(fit.sparkSession)
    rows = fit.select("packed").mapInArrow(run, ", ".join(["i int", "j int", *(f"{name} long" for name in names)]))
    found = {}
    for row in rows.groupBy("i", "j").agg(*(F.sum(name).alias(name) for name in names)).collect():
        found[row["i"], row["j"]] = sum(row[name] << (LIMB * k) for k, name in enumerate(names))
    n = found.get((-1, -1), 0)
    sums = [found.get((-1, k), 0) for k in range(length)]
    matrix = [[n * found.get((max(i, j), min(i, j)), 0) - sums[i] * sums[j] for j in range(length)] for i in range(length)]
    return Scatter(n, sums, matrix)


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2 ** 31)."""
    root = int(top**0.5) + 1
    sieve = np.ones(root + 1, bool)
    sieve[:2] = False
    for p in range(2, int(root**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    small, out, high = np.flatnonzero(sieve), [], top
    while len(out) < count:
        low = high - 200_000
        window = np.ones(200_000, bool)
        for p in small.tolist():
            window[(-low) % p :: p] = False
        out.extend((low + np.flatnonzero(window)[::-1]).tolist())
        high = low
    return out[:count]


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t I - A) mod p, highest first: A is brought to Hessenberg form by
    similarities, then its leading minors' polynomials follow from each other."""
    a = matrix % p
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # lowest coefficient first
    minors[0, 0] = 1
    for k in range(d):
        own = np.zeros(d + 1, np.int64)
        own[1:] = minors[k, :-1]
        own = (own - a[k, k] * minors[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            own = (own - chain * int(a[i, k]) % p * minors[i] % p) % p
        minors[k + 1] = own
    return minors[d, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t I - M), highest first, of a symmetric M without negative eigenvalues.

    Each prime is a row of a Spark job, which reduces the matrix modulo it; remainders meet in the
    coefficients by Chinese remaindering. The k-th one is at most C(d, k) * (trace / d) ** k
    (Maclaurin's inequality), which gives the number of primes.
    """
    d, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 2)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for p in batch.column(0).to_pylist():
            out.append(polynomial_mod(np.array([[value % p for value in row] for row in matrix], np.int64), p))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = map_batches(spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks), step, "p long, c array<long>").collect()
    modulus, values = 1, [0] * (d + 1)
    for row in rows:
        p = row["p"]
        inverse = pow(modulus % p, -1, p)
        values = [v + modulus * ((c - v) * inverse % p) for v, c in zip(values, row["c"])]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in values]


def _stretched(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2 ** bits times those of ``poly``."""
    return [c << (bits * k) for k, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots greater than ``a``, with multiplicity. All roots are real, so by Descartes'
    rule it is the number of sign changes of the coefficients of p(t + a)."""
    c = list(poly)
    for end in range(len(c) - 1, 0, -1):
        for k in range(1, end + 1):
            c[k] += a * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolated_roots(poly: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` largest positive roots of a polynomial with real roots of at least zero, falling, as (numerator,
    group), and bits: a root is numerator / 2 ** bits, to one unit. Intervals are halved, by counts of the roots above
    their middles, until they hold one root, which the sign of the polynomial then follows; those
    that still hold several at the last bit are a repeated root, a group of equal numbers."""
    d = len(poly) - 1
    while d and poly[-1] == 0:  # roots of zero
        poly, d = poly[:-1], d - 1
    if not d:
        return [], 0
    high = (-poly[1] // d).bit_length() + d.bit_length() + 1  # the trace bounds every root
    bits = max(ROOT_BITS - high, 0)
    fine = _stretched(poly, bits)

    def value(a: int) -> int:
        out = 0
        for c in fine:
            out = out * a + c
        return out

    found: list[tuple[int, int]] = []
    stack = [(0, 1 << (high + bits), 0, d)]  # (low, high], roots above high, roots above low
    group = 0
    while stack and len(found) < most:
        low, top, above, below = stack.pop()
        if below == above:
            continue
        if top - low == 1:
            found.extend([(top, group)] * (below - above))
            group += 1
        elif below - above == 1:
            while top - low > 1:
                middle = (low + top) // 2
                v = value(middle)
                if v == 0:
                    low, top = middle - 1, middle
                elif (v > 0) == (above % 2 == 0):  # as many roots above the middle as above the top
                    top = middle
                else:
                    low = middle
            found.append((top, group))
            group += 1
        else:
            middle = (low + top) // 2
            between = roots_above(fine, middle)
            stack.append((low, middle, between, below))
            stack.append((middle, top, above, between))
    return found[:most], bits


def null_vectors(matrix: list[list[int]], roots: list[tuple[int, int]], bits: int) -> np.ndarray:
    """Unit eigenvectors, a row a root, by inverse iteration with ``DIGITS`` digits, orthogonal within
    a group. The entry of the largest size is positive."""
    d, out, group_of = len(matrix), [], []
    with localcontext() as context:
        context.prec = DIGITS
        own = np.array([[Decimal(v) for v in row] for row in matrix], object)
        tiny = Decimal(max(sum(matrix[k][k] for k in range(d)), 1)).scaleb(-DIGITS + 5)
        for number, (root, group) in enumerate(roots):
            a, order, factors = own.copy(), [], []
            for k in range(d):
                a[k, k] -= Decimal(root) / Decimal(1 << bits)
            for k in range(d):
                pivot = k + int(np.argmax(np.abs(a[k:, k])))
                if pivot != k:
                    a[[k, pivot]] = a[[pivot, k]]
                if abs(a[k, k]) < tiny:
                    a[k, k] = tiny
                factor = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k:] = a[k + 1 :, k:] - factor[:, None] * a[k, k:]
                order.append(pivot)
                factors.append(factor)
            v = np.array([Decimal(1 + (7 * k * k + 13 * number * (k + 1)) % 101) for k in range(d)], object)
            for _ in range(3):
                b = v.copy()
                for k in range(d):
                    b[[k, order[k]]] = b[[order[k], k]]
                    b[k + 1 :] = b[k + 1 :] - factors[k] * b[k]
                for k in range(d - 1, -1, -1):
                    b[k] = (b[k] - (a[k, k + 1 :] * b[k + 1 :]).sum()) / a[k, k]
                b = b / max(abs(x) for x in b)
                for other, its in zip(out, group_of):
                    if its == group:
                        b = b - other * (other * b).sum()
                v = b / (b * b).sum().sqrt()
            if v[int(np.argmax(np.abs(v)))] < 0:
                v = -v
            out.append(v)
            group_of.append(group)
    return np.array([[float(x) for x in v] for v in out]).reshape(len(out), d)


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: n, sums (without the offset), components (rows), roots of the scatter and its trace."""

    length: int
    n: int
    sums: list[int]
    components: np.ndarray
    scale: np.ndarray
    explained: list[float]
    identity_error: float

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, in int64 where all squares' sums fit, else in Python's integers; and the sums of squares."""
        most = max(self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0), 1)
        kind = np.int64 if most * most * max(self.length, 1) < _LONG else object
        dev = x.astype(kind) * self.n - np.array(self.sums, kind)
        return dev, (dev * dev).sum(1)

    def whitened(self, dev: np.ndarray) -> np.ndarray:
        return dev.astype(np.float64) @ (self.components / self.scale[:, None]).T


def fit(df: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct whole-number vectors of ``df``.

    Vectors that are null, empty, or hold a null, nan or an infinite entry are left out; so are those of another
    length than most have (of equally frequent lengths the longest). Entries whose whole number is beyond
    2 ** 62 count as that. Repeated vectors count once. Components end where the covariance's rank does, known from the
    polynomial's roots of zero, so fewer than ``components`` may be given, and none of one vector. An empty table
    has length 0. Equal eigenvalues get some orthonormal vectors of their space.
    """
    spark = df.sparkSession
    own = saved(packed(df, vector_col).groupBy("length", "packed").agg(F.lit(1).alias("one")).select("length", "packed"), "vectors")
    lengths = own.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()  # a row
    if lengths is None:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.ones(0), [], 0.0)
    length = lengths["length"]
    own = own.where(F.col("length") == length).select("packed")
    s = scatter_of(own, length)
    trace = sum(s.matrix[k][k] for k in range(length))
    roots, bits = isolated_roots(characteristic_polynomial(spark, s.matrix), components) if trace else ([], 0)
    vectors = null_vectors(s.matrix, roots, bits)
    scale = np.array([float(Decimal(root) / Decimal(1 << bits)) for root, _ in roots]) ** 0.5
    explained = [float(Decimal(root) / Decimal(1 << bits) / trace) for root, _ in roots]
    made = Whitening(length, s.n, s.sums, vectors, scale, explained, 0.0)
    return Whitening(length, s.n, s.sums, vectors, scale, explained, _identity_error(own, made))


def _identity_error(own: DataFrame, made: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, from its rows."""
    k = len(made.scale)
    if not k:
        return 0.0

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        z = made.whitened(made.deviations(unpacked(batch.column(0).to_pylist(), made.length))[0])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k, dtype=np.int32)), pa.array(np.concatenate([(z.T @ z).ravel(), z.sum(0)]))], ["cell", "v"])

    cells = map_batches(own.select("packed"), step, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    sums = np.zeros(k * k + k)
    for row in cells.collect():  # k * k + k rows
        sums[row["cell"]] = row["v"]
    mean = sums[k * k :] / made.n
    return float(np.abs(sums[: k * k].reshape(k, k) / made.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(df: DataFrame, made: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_text. The deviation is null where it doesn't fit a long; its text is always exact.

    Vectors are usable as in ``fit``. Null ids stay null, repeated rows give repeated results, other columns, of
    whatever name, aren't read, and an empty table gives an empty result.
    """
    k = len(made.scale)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        lengths, values = _entries(batch.column(1))
        keep = lengths == made.length
        m = int(keep.sum())
        if not m or not k:
            return None
        good = lengths[lengths >= 0]
        x = whole(values[np.repeat(good == made.length, good)]).reshape(m, made.length)
        dev, squares = made.deviations(x)
        times = np.repeat(np.arange(m), k)
        exact = pa.array([v if v < _LONG else None for v in squares.tolist()], pa.int64())
        columns = [
            batch.column(0).filter(pa.array(keep)).take(pa.array(times)),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
            pa.array(np.full(m * k, made.n)),
            exact.take(pa.array(times)),
            pa.array(made.whitened(dev).ravel()),
            pa.array(np.tile(np.array(made.explained), m)),
            pa.array(np.full(m * k, made.identity_error)),
            pa.array(list(map(str, squares.tolist())), pa.string()).take(pa.array(times)),
        ]
        return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in schema.split(", ")])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), step, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return transform(vectors, fit(vectors))
