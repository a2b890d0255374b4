"""op12: counts, eigenvectors and whitened rows against exact sums and a full eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import whitening


def test_counts_of_negative_eigenvalues():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        a = rnd.integers(-3, 4, (d := rnd.integers(1, 10), d)).astype(float)
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        count, singular = whitening.negatives(a)
        if np.abs(values).min() > 1e-9:
            assert not singular and count == (values < 0).sum()


def test_slices_isolate_and_certify():
    rnd = np.random.default_rng(4)
    for d in (1, 2, 7, 40):
        q, _ = np.linalg.qr(rnd.standard_normal((d, d)))
        want = np.sort(rnd.random(d) * 100 + 1)[::-1]
        v = (q * want) @ q.T
        v = (v + v.T) / 2
        s = whitening.Slices(v)
        for k in range(1, min(d, 32) + 1):
            s.isolate(k)
            low, high = s.interval(k)
            assert low <= want[k - 1] * (1 + 1e-12) and want[k - 1] <= high * (1 + 1e-12) and s.above(low) == k and s.above(high) == k - 1
        values, vectors = whitening.leading(v)
        assert np.allclose(values, want[:32], rtol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(np.abs(vectors @ q[:, : len(values)]), np.eye(len(values)), atol=1e-9)


@pytest.mark.parametrize(("v", "n"), [(np.eye(6) * 3, 6), (np.diag([5.0, 5, 5, 2, 2, 0]), 5), (np.zeros((3, 3)), 0), (np.ones((4, 4)), 1), (np.diag([1.0, 1 + 1e-13, 1 - 1e-13]), 3), (np.zeros((0, 0)), 0)])
def test_ties_and_vanishing_variances(v, n):
    values, vectors = whitening.leading(v)
    assert len(values) == n and (np.diff(values) <= 0).all()
    assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12) and np.allclose(vectors @ v @ vectors.T, np.diag(values), atol=1e-12)


def _rows(n, d, seed=6):
    rnd = np.random.default_rng(seed)
    return (rnd.standard_normal((n, d)) * np.linspace(2, 0.3, d) + rnd.standard_normal((n, 1))).astype(np.float32)


def _check(got, kept, most):
    """got: rows of the result; kept: (id, vector) of the rows that remain."""
    d = max(len(v) for _, v in kept)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in kept]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    z = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in x], dtype=object)
    v = (z.T @ z).astype(float) / n**3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1].T[:most]
    w = (z.astype(float) / n) @ vectors.T / np.sqrt(values)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * len(values) and by_id.keys() == {i for i, _ in kept}
    sign = None
    for (i, _), row, own in zip(kept, z, w, strict=True):
        mine = np.array([by_id[i][k + 1].whitened for k in range(len(values))])
        sign = np.sign(mine * own) if sign is None else sign
        assert np.allclose(mine, sign * own, atol=1e-8)
        assert all(r.n == n and r.deviation == sum(int(a) ** 2 for a in row) for r in by_id[i].values())
    assert np.allclose([by_id[kept[0][0]][k + 1].explained for k in range(len(values))], values / np.trace(v), rtol=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize(("d", "most"), [(5, 32), (40, 32), (40, 3)])
def test_against_a_full_decomposition(spark, d, most):
    rows = list(enumerate(_rows(300, d).tolist()))
    bad = [(900, None), (901, [float("nan")] * d), (902, [1.0, None] + [0.0] * (d - 2)), (903, [float("inf")] + [0.0] * (d - 1)), (904, [1e30] * d)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").repartition(3).withColumn("x", F.lit(1)).withColumn("e", F.lit("e"))
    _check(whitening.whiten(df, most).collect(), rows, most)


def test_short_vectors_end_in_zeros(spark):
    rows = [(i, v[: 3 + i % 2]) for i, v in enumerate(_rows(50, 4).tolist())]
    _check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows, 32)


def test_repeated_rows_and_ids_count_each(spark):
    v = _rows(30, 3).tolist()
    df = spark.createDataFrame([(None, v[0]), (1, v[1]), (1, v[1]), (1, v[2])] + [(i, x) for i, x in enumerate(v[3:], 5)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 31 * 3 and {r.n for r in got} == {31} and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 1 for r in got) == 9


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_the_same_however_rows_are_dealt(spark):
    df = spark.createDataFrame(list(enumerate(_rows(200, 6).tolist())), "vec_id long, embedding array<float>")
    one, five = ({(r.vec_id, r.component): (r.whitened, r.explained) for r in whitening.whiten(df.repartition(k)).collect()} for k in (1, 5))
    assert one.keys() == five.keys() and all(abs(one[k][0] - five[k][0]) < 1e-12 and one[k][1] == five[k][1] for k in one)


def test_sums_beyond_floating_point_are_exact(spark):
    rows = [(1, [2.0**32, 1.0]), (2, [-(2.0**32), 5.0]), (3, [7.0, 2.0**31])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-6
