"""Whitening of embeddings by spectrum slicing.

Entries c become whole numbers x = floor(1024 c) + 100000. Sums and counts are exact; the covariance is that of
all vectors (divisor n), whose entries are centred, (n x - S) / n, before they are multiplied. It is as wide as an
embedding, so it and its leading eigenvectors fit on the driver whatever the number of vectors.

1. Householder reflections make the covariance tridiagonal, which changes no eigenvalue. For a shift s the pivots of
   LDL^T of the shifted matrix have as many negative signs as there are eigenvalues below s (inertia), which is
   stable for a tridiagonal matrix without pivoting.
2. Counts at many shifts at once slice the spectrum until each leading eigenvalue has an interval of its own.
3. From the middle of its interval Rayleigh quotient iteration converges cubically to the eigenvector; a quotient that
   leaves the interval is replaced by the middle of a narrower one.
4. Counts just above and below each result certify its number. Eigenvalues that no double can tell apart share
   an interval; their vectors are made orthogonal to the earlier ones.

Rows whose vector is null or holds null or non-finite entries are dropped, as are vectors of another length than most
(of equally frequent lengths, the greater counts), since no covariance is defined for them. A null, repeated or
clashing id and repeated rows stay rows of their own. x ends at plus and minus 2^62; a deviation beyond 64 bits is null.
With fewer than `components` dimensions all are returned. A component without variance has whitened 0, so identity_error is
1 then. An empty table, or one without any vector left, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaytally.llm.common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Shifts that the counts look at in each round, relative width at which an eigenvalue counts as found.
SHIFTS, EXACT = 32, 4 * np.finfo(float).eps


def finite(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """x of each entry, by row."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(SCALE * c) + SHIFT, -(2.0**62), 2.0**62 - 1024).astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit numbers where they suffice, else as Python's."""
    largest = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // n)
    return n * x - np.array(sums, np.int64) if 2 * n * (largest + 1) < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, null beyond 64 bits."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in y]
    return [t if t < 1 << 63 else None for t in totals]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if not norm or not np.abs(x[1:]).max():
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0] if x[0] else v[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Spectrum:
    """The eigenvalues of a symmetric matrix, counted by inertia."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.diagonal, off = tridiagonal(matrix)
        self.squares = off * off
        radius = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
        self.scale = float((np.abs(self.diagonal) + radius).max(initial=0))  # no eigenvalue is larger
        self.tiny = max(self.scale, 1e-290) * np.finfo(float).eps ** 2

    def above(self, shifts: np.ndarray) -> np.ndarray:
        """How many eigenvalues are at least each shift: the pivots of LDL^T of (matrix - shift) that aren't negative."""
        count = np.zeros(len(shifts), np.int64)
        pivot = np.ones(len(shifts))
        for i, a in enumerate(self.diagonal):
            pivot = a - shifts - (self.squares[i - 1] / pivot if i else 0.0)
            pivot = np.where(np.abs(pivot) < self.tiny, -self.tiny, pivot)
            count += pivot > 0
        return count

    def sliced(self, low: float, high: float, number: int) -> tuple[float, float]:
        """A narrower interval that holds the number-th eigenvalue from above, if [low, high) does."""
        shifts = np.linspace(low, high, SHIFTS + 2)[1:-1]
        enough = self.above(shifts) >= number
        last = int(enough.sum())  # counts fall as shifts rise
        return (shifts[last - 1] if last else low), (shifts[last] if last < len(shifts) else high)

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k largest eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive."""
        size = len(self.matrix)
        values, vectors = np.zeros(k), np.eye(size, k)
        for i in range(k if self.scale else 0):
            value, vector = self._pair(i + 1, vectors[:, :i])
            values[i], vectors[:, i] = value, vector * np.copysign(1.0, vector[np.abs(vector).argmax()])
        return values, vectors

    def _pair(self, number: int, earlier: np.ndarray) -> tuple[float, np.ndarray]:
        width = EXACT * self.scale
        low, high = -self.scale - width, self.scale + width
        while high - low > width:
            counts = self.above(np.array([low, high]))
            if counts[0] == number and counts[1] == number - 1:  # alone in its interval
                found = self._iterated(low, high, earlier)
                if found and self._certified(found[0], number):
                    return found
            low, high = self.sliced(low, high, number)
        return self._inverse((low + high) / 2, earlier, 4)  # the interval itself certifies the value

    def _certified(self, value: float, number: int) -> bool:
        margin = 4 * len(self.matrix) * EXACT * self.scale
        counts = self.above(np.array([value - margin, value + margin]))
        return counts[0] >= number > counts[1]

    def _apart(self, vector: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        for _ in range(2):
            vector = vector - earlier @ (earlier.T @ vector)
        return vector / np.linalg.norm(vector)

    def _solved(self, shift: float, vector: np.ndarray) -> np.ndarray:
        for step in range(1, 9):
            try:
                found = np.linalg.solve(self.matrix - shift * np.eye(len(vector)), vector)
                if np.isfinite(found).all() and found.any():
                    return found / np.linalg.norm(found)
            except np.linalg.LinAlgError:
                pass
            shift += step * EXACT * max(self.scale, 1e-290)  # the shift was an eigenvalue to the last bit
        return vector

    def _inverse(self, shift: float, earlier: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
        vector = self._apart(np.random.default_rng(len(earlier.T)).standard_normal(len(self.matrix)), earlier)
        for _ in range(steps):
            vector = self._apart(self._solved(shift, vector), earlier)
        return float(vector @ self.matrix @ vector), vector

    def _iterated(self, low: float, high: float, earlier: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration from the middle of an interval with one eigenvalue; None if it leaves it."""
        value, vector = self._inverse((low + high) / 2, earlier, 2)
        residual = np.inf
        for _ in range(12):
            if not low <= value < high:
                return None
            now = float(np.linalg.norm(self.matrix @ vector - value * vector))
            if now >= residual / 2 and residual <= 64 * EXACT * self.scale:  # as near as doubles come
                return value, vector
            residual = now
            vector = self._apart(self._solved(value, vector), earlier)
            value = float(vector @ self.matrix @ vector)
        return (value, vector) if residual <= 64 * EXACT * self.scale else None


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and the exact sums of x by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, np.zeros(width, object)
        for part in batches:
            x = whole_numbers(part.column(0), width)
            n += len(x)
            large = float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62
            totals = totals + (x.astype(object) if large else x).sum(0).astype(object)
        numbers = pa.array([Decimal(n), *(Decimal(int(v)) for v in totals)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), numbers], names=["i", "total"])

    rows = vectors.select("vector").mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).orderBy("i").collect()  # a row a dimension
    totals = [int(r["total"]) for r in rows] or [0]
    return totals[0], totals[1:]


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    width = len(sums)
    upper = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in batches:
            z = (centred(whole_numbers(part.column(0), width), n, sums) / n).astype(np.float64)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["i", "total"])

    rows = vectors.select("vector").mapInArrow(multiply, "i long, total double").groupBy("i").agg(F.sum("total").alias("total")).orderBy("i").toArrow()  # width^2 / 2 numbers
    found = np.zeros((width, width))
    found[upper] = rows["total"].to_numpy() / n
    return np.triu(found) + np.triu(found, 1).T


def whitened(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    kind = embeddings.schema[id].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = embeddings.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    widths = own.groupBy(F.size("vector").alias("width")).count()
    usual = widths.where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None or components < 1:
        return embeddings.sparkSession.createDataFrame([], result)
    width = usual["width"]
    own = own.where(F.size("vector") == width)
    n, sums = _sums(own, width)
    matrix = _covariance(own, n, sums)
    k, trace = min(components, width), float(np.trace(matrix))
    values, vectors = Spectrum(matrix).leading(k)
    some = values > width * np.finfo(float).eps * trace
    weights = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            y = centred(whole_numbers(part.column(1), width), n, sums)
            w = (y / n).astype(np.float64) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(y), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    rows = written(own.mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>"), "whitened")
    explained = F.array(*(F.lit(float(v / trace) if trace > 0 else 0.0) for v in values))
    error = F.lit(identity_error(rows, k))
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), error.alias("identity_error"))


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    means = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    z = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*(F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))
