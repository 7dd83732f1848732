"""Operator 11 against exact fractions and dense solves, and its odd cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from countloom.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n double"
RNG = np.random.default_rng(3)


def faddeev(matrix):
    """Characteristic polynomial by traces of powers, in fractions."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(Fraction(matrix[i][h]) * m[h][j] for h in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(sum(Fraction(matrix[i][h]) * m[h][i] for h in range(d)) for i in range(d)) / k)
    return [int(c) for c in out]


def scatter(rows):
    rows = [list(map(int, r)) for r in {tuple(r) for r in rows}]
    n, d = len(rows), len(rows[0])
    return [[n * sum(r[i] * r[j] for r in rows) - sum(r[i] for r in rows) * sum(r[j] for r in rows) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d, n, size", [(1, 5, 9), (2, 3, 4), (5, 40, 50), (6, 4, 9), (7, 30, 10**6)])
def test_polynomial_and_roots(spark, d, n, size):
    """Rank-deficient ones too: as many roots of zero as dimensions without rows."""
    matrix = scatter(RNG.integers(-size, size, (n, d)))
    poly = whiten.characteristic_polynomial(spark, matrix)
    assert poly == faddeev(matrix)
    roots, bits = whiten.isolated_roots(poly, d)
    want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    assert len(roots) == np.linalg.matrix_rank(np.array(matrix, float))
    assert np.allclose([r / 2**bits for r, _ in roots], want[: len(roots)], rtol=1e-9)
    vectors = whiten.null_vectors(matrix, roots, bits)
    for (root, _), v in zip(roots, vectors):
        assert np.abs(np.array(matrix, float) @ v - root / 2**bits * v).max() < 1e-9 * want[0]
    assert np.allclose(vectors @ vectors.T, np.eye(len(roots)), atol=1e-12)


def test_repeated_roots_get_orthonormal_vectors(spark):
    q = np.array([[2, -1, 2], [2, 2, -1], [-1, 2, 2]])  # 9 times a rotation
    matrix = (q @ np.diag([7, 7, 2]) @ q.T).tolist()
    roots, bits = whiten.isolated_roots(whiten.characteristic_polynomial(spark, matrix), 3)
    assert [Fraction(r, 2**bits) for r, _ in roots] == [63, 63, 18] and [g for _, g in roots] == [0, 0, 1]
    vectors = whiten.null_vectors(matrix, roots, bits)
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-14) and np.allclose(np.array(matrix) @ vectors.T, vectors.T * [63, 63, 18])


def test_products_are_exact_at_any_size():
    for size in (5, 2**20, 2**40, 2**61):
        x = RNG.integers(-size, size, (1500, 3))
        want = [[sum(a * b for a, b in zip(x[:, i].tolist(), x[:, j].tolist())) for j in range(3)] for i in range(3)]
        assert whiten.exact_products(x).tolist() == want
        for value in (want[0][0], -want[1][1], want[0][1]):
            assert sum(limb << (whiten.LIMB * k) for k, limb in enumerate(whiten._limbs(value))) == value


def collect(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = whiten.fit(df, **kwargs)
    return made, whiten.transform(df, made).toPandas()


def test_odd_rows(spark):
    """Nulls, nan, infinity, other lengths, copies, clashing names, null and repeated ids."""
    good = [(k, RNG.normal(size=4).tolist(), k, "x", None) for k in range(30)]
    odd = [(50, None, 1, "a", 1.0), (51, [1.0, None, 2.0, 3.0], None, None, None), (52, [1.0, float("nan"), 0.0, 0.0], 1, "b", 1.0), (53, [float("inf"), 0.0, 0.0, 0.0], 1, "b", 1.0), (54, [], 1, "c", 2.0), (55, [1.0, 2.0], 1, "c", 2.0)]
    more = [(60, good[0][1], None, None, None), (3, good[3][1], 3, "x", None), (None, good[1][1], 3, "x", None)]
    made, got = collect(spark, good + odd + more)
    assert made.n == 30 and len(got) == 33 * 4 and got["vec_id"].isna().sum() == 4
    x = np.floor(64 * np.array([np.float32(r[1]) for r in good], float))
    dev = x - x.mean(0)
    values, vectors = np.linalg.eigh(dev.T @ dev / 30)
    want = (dev @ vectors / values**0.5)[:, ::-1]
    for k in range(30):
        own = got[got["vec_id"] == k].drop_duplicates("component").sort_values("component")
        assert np.allclose(np.abs(own["whitened"]), np.abs(want[k]), atol=1e-9)
        assert set(own["deviation"]) == {int(((30 * x[k] - x.sum(0)) ** 2).sum())} and list(own["component"]) == [1, 2, 3, 4]
    assert np.allclose(got[got["vec_id"] == 5].sort_values("component")["explained"], values[::-1] / values.sum())
    assert (got["identity_error"] < 1e-12).all()


def test_no_rank_no_rows_and_huge_entries(spark):
    assert len(collect(spark, [(1, [1.0, 2.0], 1, "", 0.0)] * 3)[1]) == 0
    made, got = collect(spark, [(1, None, 1, "", 0.0)])
    assert made.length == 0 and len(got) == 0
    made, got = collect(spark, [(1, [1.0, 1e30], 1, "", 0.0), (2, [3.0, -1e30], 1, "", 0.0), (3, [5.0, 2.0], 1, "", 0.0)])
    assert made.n == 3 and set(got["component"]) == {1, 2}
    assert all(math.isfinite(v) for v in got["whitened"])
    for vec_id, deviation, text in zip(got["vec_id"], got["deviation"], got["deviation_text"]):
        assert int(text) == deviation if vec_id == 3 else int(text) > 2**63 and math.isnan(deviation)


def test_fewer_components(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = whiten.fit(df, components=3)
    assert made.components.shape == (3, 64) and made.identity_error < 1e-10
    assert whiten.transform(df, made).count() == 3 * df.count()
