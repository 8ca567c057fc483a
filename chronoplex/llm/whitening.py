"""Embedding whitening through a bidiagonal matrix: the covariance itself is never formed.

Rows are centred by their exact sums and reduced by blockwise QR, in tasks first and then task by task in a tree, to one triangle R of the vectors'
dimension. Householder reflections make R bidiagonal; the differential quotient-difference algorithm with shifts (dqds) finds the squares of its
singular values, each to high relative accuracy; twisted factorisations give the right singular vectors, which are the whitening directions. Only the triangle
and the directions, of a size that the dimension fixes, are seen by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Numbers are floor(GRID * entry) + OFFSET; entries beyond LARGEST would leave the exact range of doubles and count as not finite.
GRID, OFFSET, LARGEST = 64, 1_000_000, float(1 << 46)
#: Rows that are reduced at once, and partial results that one task brings together.
ROWS_AT_ONCE, FAN_IN = 1024, 16
_EPS = np.finfo(np.float64).eps


def usable(vector: Column) -> Column:
    """Vectors that are there and hold nothing but finite numbers."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)), F.lit(False))


def _numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, width) whole numbers."""
    return np.floor(GRID * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, width) + OFFSET


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector: rows, and the exact sum of each dimension."""
    found: dict[int, list] = {}
    for batch in _runs(batches):
        length = pc.list_value_length(batch.column("vector")).to_numpy()
        for width in np.unique(length).tolist():
            x = _numbers(batch.column("vector").filter(pa.array(length == width)), width)
            n, total = found.get(width, (0, [0] * width))
            found[width] = n + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
    for width, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n]), pa.array([total], pa.list_(pa.decimal128(38, 0)))], names=["width", "n", "sums"])


def _folded(parts: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """All partial results ``part`` joined, FAN_IN at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for x in batch.column("part"):
                now = np.frombuffer(x.as_buffer(), dtype=np.float64)
                held = now if held is None else join(held, now)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()])], names=["part"])

    parts = cut(parts)
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(fold, "part binary")
    row = parts.first()
    return None if row is None else np.frombuffer(row[0], dtype=np.float64)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factors, square whatever the number of rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, with a = U B V'."""
    a, d = a.copy(), len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.any(x[1:]):
            return np.zeros_like(x), 0.0
        u = x / scale
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u, 2.0 / (u @ u)

    for k in range(d):
        u, t = reflector(a[k:, k])
        a[k:, k:] -= t * np.outer(u, u @ a[k:, k:])
        if k + 2 < d:
            u, t = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= t * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= t * np.outer(v[:, k + 1:] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _step(q: list[float], e: list[float], lo: int, hi: int, shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform of q[lo:hi], e[lo:hi-1]: the new ones and the least of the auxiliary values, not positive if the shift is too large."""
    new_q, new_e = [0.0] * (hi - lo), [0.0] * (hi - lo - 1)
    d = q[lo] - shift
    least = d
    for i in range(lo, hi - 1):
        t = d + e[i]
        if t <= 0:
            return new_q, new_e, -1.0
        new_q[i - lo] = t
        new_e[i - lo] = e[i] * (q[i + 1] / t)
        d = d * (q[i + 1] / t) - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B'B for the squares ``q`` of B's diagonal and ``e`` of its upper diagonal; all q are positive."""
    q, e, found = q.tolist(), e.tolist(), []
    todo = [(0, len(q), 0.0)]
    while todo:
        lo, hi, taken = todo.pop()
        while hi > lo:
            small = [i for i in range(lo, hi - 1) if e[i] <= _EPS * _EPS * (taken + q[i]) or e[i] <= 1e-300]
            if hi - lo == 1 or (small and small[-1] == hi - 2):
                found.append(taken + q[hi - 1])
                hi -= 1
                continue
            if small:
                todo.append((lo, small[-1] + 1, taken))
                lo = small[-1] + 1
                continue
            # the smallest eigenvalue of the last two rows is near the smallest of all, one over the trace of the inverse is below it
            a, b = q[hi - 1], q[hi - 2] + e[hi - 2]
            half = (a + b) / 2
            corner = q[hi - 2] * q[hi - 1] / (half + (max(0.0, half * half - q[hi - 2] * q[hi - 1])) ** 0.5)
            d, inverse = q[lo], 1 / q[lo] if q[lo] > 0 else np.inf
            for i in range(lo, hi - 1):
                d = d * (q[i + 1] / (d + e[i])) if d + e[i] > 0 else 0.0
                inverse += 1 / d if d > 0 else np.inf
            safe = 0.0 if not np.isfinite(inverse) else (1 - 8 * (hi - lo) * _EPS) / inverse
            for shift in (corner * (1 - 1e-10), corner * 0.99, (corner + safe) / 2, safe, 0.0):
                now_q, now_e, least = _step(q, e, lo, hi, shift)
                if least >= 0:
                    break
            q[lo:hi], e[lo: hi - 1] = now_q, now_e
            taken += shift
    return np.sort(np.array(found))[::-1]


def twisted(q: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its falling eigenvalues, orthogonal to double precision; q and e as for ``dqds``.

    B'B = L D L' has D = q and subdiagonal l = sqrt(e / q) of L. Factorisations from the top and from the bottom are twisted together where the pivot is least.
    """
    d, l = len(q), np.sqrt(e / q[:-1])
    tiny = _EPS * _EPS * max(q.max(), e.max(initial=0.0))
    nonzero = lambda x: np.where(np.abs(x) < tiny, tiny, x)
    guess = values.astype(np.float64).copy()
    for _ in range(rounds):
        s, p = np.empty((d, len(guess))), np.empty((d, len(guess)))
        down, up = np.empty((d - 1, len(guess))), np.empty((d - 1, len(guess)))
        s[0] = -guess
        for i in range(d - 1):
            down[i] = q[i] * l[i] / nonzero(s[i] + q[i])
            s[i + 1] = down[i] * l[i] * s[i] - guess
        p[-1] = q[-1] - guess
        for i in range(d - 2, -1, -1):
            t = q[i] / nonzero(q[i] * l[i] ** 2 + p[i + 1])
            up[i] = l[i] * t
            p[i] = p[i + 1] * t - guess
        pivot = s + p + guess
        at = np.abs(pivot).argmin(axis=0)
        z = np.zeros((d, len(guess)))
        z[at, np.arange(len(guess))] = 1
        for i in range(d - 2, -1, -1):
            z[i] = np.where(i < at, -down[i] * z[i + 1], z[i])
        for i in range(d - 1):
            z[i + 1] = np.where(i >= at, -up[i] * z[i], z[i + 1])
        length = (z * z).sum(axis=0)
        guess = guess + pivot[at, np.arange(len(guess))] / length
        z /= np.sqrt(length)
    # vectors of eigenvalues too close to tell apart span their space after a few solves that start at random and are made orthogonal
    gap = np.abs(np.diff(values)) > 1e-8 * values[:-1]
    first = np.flatnonzero(np.concatenate([[True], gap]))
    rng = np.random.default_rng(3)
    t_diagonal, t_off = q + np.concatenate([[0.0], e]), np.sqrt(q[:-1] * e)
    for lo, hi in zip(first, np.append(first[1:], d)):
        if hi - lo > 1:
            x = rng.normal(size=(d, hi - lo))
            matrix = np.diag(t_diagonal - values[lo:hi].mean() * (1 + 1e-13)) + np.diag(t_off, 1) + np.diag(t_off, -1)
            for _ in range(4):
                x = np.linalg.qr(np.linalg.solve(matrix, x))[0]
            z[:, lo:hi] = x
    for _ in range(3):  # what is nearly orthogonal becomes so to double precision
        z = z @ (1.5 * np.eye(z.shape[1]) - 0.5 * (z.T @ z))
    return z


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of R, falling, and its right singular vectors as columns; without those that vanish in double precision."""
    size = np.abs(r).max(initial=0.0)
    live = np.flatnonzero(np.abs(r).max(axis=0, initial=0.0) > 0)
    if size == 0:
        return np.zeros(0), np.zeros((len(r), 0))
    a, b, v = bidiagonalise(triangle(r[:, live]) / size)
    sign = np.cumprod(np.concatenate([[1.0], np.where((b < 0) ^ (a[:-1] < 0), -1.0, 1.0)]))  # B is one of positive numbers between two of signs
    a = np.maximum(np.abs(a), _EPS * np.sqrt((a * a).sum() + (b * b).sum()))  # zero to rounding
    q, e = a * a, b * b
    values = dqds(q, e)
    kept = values > (len(live) * _EPS) ** 2 * values[0] * 16
    full = np.zeros((len(r), len(live)))
    full[live] = v @ (sign[:, None] * twisted(q, e, values))
    return values[kept] * size * size, full[:, kept]


@dataclass
class Whitening:
    """What ``fit_whitening`` found: rows, exact sums, trace of the covariance, its eigenvalues and the directions (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    directions: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        room = 2 * self.n * max(int(np.abs(x).max(initial=1)), 1) < 1 << 63
        return self.n * x - np.array(self.sums, dtype=np.int64) if room else self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def white(self, x: np.ndarray, components: int) -> np.ndarray:
        return self.centred(x) @ (self.directions[:, :components] / np.sqrt(self.values[:components]))


def fit_whitening(rows: DataFrame) -> Whitening | None:
    """Fit on all rows of ``vector`` (usable vectors); vectors whose length is not the commonest one (the longest of the commonest) take no part."""
    found = cut(rows.select("vector").mapInArrow(_sums, "width int, n long, sums array<decimal(38,0)>"))
    width = found.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return None
    parts = found.filter(F.col("width") == width.width).select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    sums = [int(r.x) for r in parts.orderBy("at").collect()]  # one row per dimension
    model = Whitening(width.n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    d = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in _runs(batches):
            x = model.centred(_numbers(batch.column("vector"), d))
            r = triangle(x if r is None else np.vstack([r, x]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["part"])

    of_width = rows.filter(F.size("vector") == d).select("vector")
    r = _folded(of_width.mapInArrow(reduce, "part binary"), lambda a, b: triangle(np.vstack([a.reshape(d, d), b.reshape(d, d)])).ravel()).reshape(d, d)
    squares, model.directions = directions(r)
    model.values, model.trace = squares / model.n, float((r * r).sum() / model.n)
    return model


def whiten(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries are left out, also those of another length than the commonest. Components are numbered
    from 1 by falling eigenvalue; those without variance (to double precision) cannot be whitened and have no rows, so equal vectors alone, or a single
    one, give none. ``deviation`` is exact (decimal). ``identity_error`` is the largest absolute entry of the whitened rows' covariance minus the identity.
    Rows with a null key, or that repeat, stay. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    schema = f"key {docs.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit_whitening(rows)
    k = 0 if model is None else min(components, len(model.values))
    if k == 0:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    d = len(model.sums)
    of_width = rows.filter(F.size("vector") == d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in _runs(batches):
            w = model.white(_numbers(batch.column("vector"), d), k)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    total = _folded(of_width.select("vector").mapInArrow(moments, "part binary"), np.add).reshape(k + 1, k) / model.n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            x = _numbers(batch.column("vector"), d)
            m, far = len(x), model.deviations(x)
            room = far.dtype != object and d * int(np.abs(far).max(initial=0)) ** 2 < 1 << 63
            square = (far * far).sum(axis=1) if room else (far.astype(object) ** 2).sum(axis=1)
            deviation = pa.array(square).cast(pa.decimal128(38, 0)) if room else pa.array(square.tolist(), pa.decimal128(38, 0))
            of = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(of),
                 pa.array(model.white(x, k).ravel()), pa.array(np.tile(model.values[:k] / model.trace, m)), pa.array(np.full(m * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return of_width.mapInArrow(white, schema).withColumnRenamed("key", key)
