"""Embedding whitening by spectrum slicing.

Entries become whole numbers, so counts, sums and products are exact and the same in every run, however the rows are dealt.
The covariance is small (dimension squared) and its spectrum is sliced on the driver: the inertia of V - s I, read off an
LDLT factorisation, tells how many eigenvalues exceed s. Bisection by such counts isolates each leading eigenvalue, Rayleigh
quotient iteration converges to it cubically, and the counts at the ends of its interval certify its number. The rows are
then projected in tasks; what is said about them (identity_error) is measured on the projected rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluice.tables import keep, table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000  # x = floor(SCALE * c) + OFFSET
LARGEST = 2.0**33  # entries beyond it have no exact place in longs
EPS = float(np.finfo(np.float64).eps)
_PIVOT = (1 + sqrt(17)) / 8  # bound of the growth in a factorisation with pivots of one or two rows


def negatives(a: np.ndarray) -> tuple[int, bool]:
    """How many eigenvalues of a symmetric matrix are negative, by the signs of D in L D LT (Bunch and Kaufman's pivots of one
    row or two; one of two rows has an eigenvalue of either sign), and whether a pivot vanished, so that a shift hit one."""
    m, count, singular = a.copy(), 0, False
    tiny = EPS * EPS * max(float(np.abs(a).max(initial=0)), 1e-300)
    while len(m):
        below = np.abs(m[1:, 0])
        r = int(below.argmax()) + 1 if len(below) else 0
        most, two = (float(below[r - 1]) if r else 0.0), False
        if abs(m[0, 0]) < _PIVOT * most:
            row = np.abs(m[r])
            row[r] = 0
            far = float(row.max())
            if abs(m[0, 0]) * far < _PIVOT * most * most:
                two = abs(m[r, r]) < _PIVOT * far
                swap = (1, r) if two else (0, r)
                m[list(swap)] = m[list(swap[::-1])]
                m[:, list(swap)] = m[:, list(swap[::-1])]
        if two:
            count += 1
            c = m[2:, :2]
            m = m[2:, 2:] - c @ np.linalg.solve(m[:2, :2], c.T)
            continue
        d = float(m[0, 0])
        if abs(d) <= tiny:
            singular = True
            m = m[1:, 1:]
            continue
        count += d < 0
        c = m[1:, 0]
        m = m[1:, 1:] - np.outer(c, c / d)
    return count, singular


class Slices:
    """Counts of the eigenvalues above shifts, each shift factorised once."""

    def __init__(self, v: np.ndarray):
        self.v, self.norm = v, float(np.abs(v).sum(axis=1).max(initial=0))
        self.narrow = 4 * EPS * self.norm * max(1, len(v))  # eigenvalues closer than this cannot be told apart
        self.shifts, self.counts = [-2 * self.norm - 1, 2 * self.norm + 1], [len(v), 0]

    def above(self, shift: float) -> int:
        at = bisect_left(self.shifts, shift)
        if at < len(self.shifts) and self.shifts[at] == shift:
            return self.counts[at]
        s, step = shift, EPS * self.norm
        while True:
            less, singular = negatives(self.v - s * np.eye(len(self.v)))
            if not singular:
                break
            s, step = s - step, 2 * step  # an eigenvalue that is hit counts as above
        self.shifts.insert(at, shift)
        self.counts.insert(at, len(self.v) - less)
        return len(self.v) - less

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known (low, high) with k eigenvalues or more above low, and fewer above high."""
        low = max(i for i, c in enumerate(self.counts) if c >= k)
        return self.shifts[low], self.shifts[low + 1]

    def halve(self, k: int) -> None:
        low, high = self.interval(k)
        self.above(low / 2 + high / 2)

    def isolate(self, k: int) -> None:
        """Until the k-th eigenvalue is alone in its interval, or the interval is as narrow as rounding."""
        while True:
            low, high = self.interval(k)
            if (self.above(low), self.above(high)) == (k, k - 1) or high - low <= self.narrow:
                return
            self.halve(k)


def _quotient_iteration(s: Slices, low: float, high: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """Inverse iteration at the interval's middle, then with the Rayleigh quotient as shift, across the vectors found before."""
    v, eye = s.v, np.eye(len(s.v))

    def across(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - found.T @ (found @ w)
        return w / np.sqrt(w @ w)

    w = across(np.random.default_rng(seed).standard_normal(len(v)))
    shift = low / 2 + high / 2
    for step in range(60):
        try:
            z = np.linalg.solve(v - shift * eye, w)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(v - (shift + 2 * EPS * s.norm) * eye, w)
        size = float(np.sqrt(z @ z))
        w = across(z / size)
        if step >= 2:
            shift = float(w @ v @ w)
            residual = v @ w - shift * w
            if float(np.sqrt(residual @ residual)) <= 8 * EPS * s.norm and step >= 4:
                break
    return float(w @ v @ w), w


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive semidefinite matrix, falling, and their unit vectors as rows; those that
    cannot be told from zero are left out."""
    s = Slices(v)
    values, vectors = [], np.zeros((0, len(v)))
    for k in range(1, min(most, len(v) if s.norm else 0) + 1):
        if s.above(2 * s.narrow) < k:
            break
        s.isolate(k)
        while True:
            low, high = s.interval(k)
            e, w = _quotient_iteration(s, low, high, vectors, k)
            slack = s.narrow
            if low - slack <= e <= high + slack or high - low <= s.narrow:
                break
            s.halve(k)  # it went to a neighbour: begin closer
        values.append(e)
        vectors = np.vstack([vectors, w])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[order]


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """A column of lists as a matrix; what a list is short of `dim` counts as a c of 0."""
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (starts == dim).all():
        return flat.reshape(len(column), dim).astype(kind)
    out = np.full((len(column), dim), OFFSET if kind is np.int64 else 0, kind)
    out[np.arange(dim) < starts[:, None]] = flat
    return out


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for b in batches:
            x = _matrix(b.column("x"), dim, np.int64)
            n += len(x)
            total = total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "n", "s"]
        )

    return run


def _products(base: np.ndarray, dim: int):
    """Sums of (x_i - base_i)(x_j - base_j), exact: in floating point as long as that holds them, else in whole numbers."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for b in batches:
            y = _matrix(b.column("x"), dim, np.int64) - base
            most = float(np.abs(y).max(initial=0)) ** 2 * len(y)
            if most < 2.0**53:
                f = y.astype(np.float64)
                part = (f.T @ f).astype(np.int64).astype(object)
            else:
                part = (y.T @ y if most < 2.0**62 else y.astype(object).T @ y.astype(object)).astype(object)
            total = total + part
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(map(Decimal, total[upper]), pa.decimal128(38, 0))], ["i", "j", "s"]
        )

    return run


def _project(n: int, sums: list[int], basis: np.ndarray, values: np.ndarray):
    s = np.array(sums, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = n * _matrix(b.column("x"), len(s), np.int64) - s
            rough = (d.astype(np.float64) ** 2).sum(axis=1)
            deviation = [int(v) if r < 2.0**62 else sum(int(x) ** 2 for x in row) for v, r, row in zip((d * d).sum(axis=1), rough, d, strict=True)]
            w = ((d / n) @ basis.T) / np.sqrt(values)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), lists], ["vec_id", "deviation", "w"]
            )

    return run


def _moments(means: np.ndarray | None, k: int):
    """Sums of w (means None) or of the products of w - means."""
    i, j = (np.arange(k), np.zeros(k, int)) if means is None else np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if means is None else (k, k))
        for b in batches:
            w = _matrix(b.column("w"), k, np.float64)
            total += w.sum(axis=0) if means is None else (w - means).T @ (w - means)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total if means is None else total[i, j])], ["i", "j", "s"])

    return run


def _identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of w less the identity, from the rows as they are."""
    shape = "i int, j int, s double"
    total = {r["i"]: r["s"] for r in rows.mapInArrow(_moments(None, k), shape).groupBy("i").agg(F.sum("s").alias("s")).collect()}  # k numbers
    means = np.array([total[i] / n for i in range(k)])
    products = rows.mapInArrow(_moments(means, k), shape).groupBy("i", "j").agg((F.sum("s") / n).alias("s"))
    return float(products.agg(F.max(F.abs(F.col("s") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row that remains and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries, or ones beyond 2^33, are dropped. Each remaining row counts,
    those of null or repeated ids too. Vectors shorter than the longest count as ending in zeros. A table with no row, or
    whose rows are all equal, has no component and gives no row; components whose variance rounding cannot tell from zero
    are left out. Of equal eigenvalues any orthonormal vectors are taken. `deviation` is null where a long cannot hold it.

    The driver holds dimension^2 numbers and factorises such a matrix some ten times a component; each task sends half as
    many sums, which are added by (i, j). Rows go through tasks in Arrow batches."""
    entries = F.col("e")
    good = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))  # not for NaN, which is above all
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & good).select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], schema)
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return none
    sums = rows.mapInArrow(_sums(dim), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    base = [s // n for s in total]
    products = rows.mapInArrow(_products(np.array(base, np.int64), dim), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    v, rest = np.zeros((dim, dim)), [s - n * m for s, m in zip(total, base, strict=True)]
    for r in products:  # n^2 times the covariance is a whole number
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    values, basis = leading(v, components)
    if not len(values):
        return none
    done = keep(rows.mapInArrow(_project(n, total, basis, values), "vec_id long, deviation long, w array<double>"), "whitened")
    error = _identity_error(done, n, len(values))
    parts = F.array(*[F.lit(float(e / np.trace(v))) for e in values])

    def explained(component: Column) -> Column:
        return F.element_at(parts, component)

    out = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained(F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
