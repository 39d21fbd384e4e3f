"""Embedding whitening (operator 12).

1. *Grid*: every entry c becomes the integer ``floor(scale * c) + shift``, so that sums are exact whatever their order.
2. *Moments*: count and sums of all vectors, then the covariance about the exact mean; tasks add up their rows' products
   and put out one matrix each, row by row, which Spark adds up by row. The driver gets the d x d result only.
3. *Eigenpairs*: Householder reflections bring the covariance to tridiagonal form; bisection on the number of sign changes
   (Sturm counts) finds its leading eigenvalues, all at once; inverse iteration, orthogonalised within clusters of close
   values, their vectors, which the reflections turn back.
4. *Projection*: the components, at most d x k numbers, go to every task; each row is projected where it is read.

Work on the driver depends on the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the grid.
SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Entries from this size on do not fit the grid and count as non-finite.
LARGEST = 2.0**45
#: Rows that a task multiplies at a time.
ROWS = 4096
#: Eigenvalues that are this share of the trace or less are zero but for rounding.
NOTHING = 1e-13
LONG = 1 << 63
LOW = 24


# Eigenpairs of a symmetric matrix.


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``a``, and the reflections that lead to it."""
    a = np.array(a, float)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        below = np.abs(x[1:]).max(initial=0.0)
        v = np.zeros_like(x)
        if below > 0:
            size = np.abs(x).max()
            v = x / size
            length = np.sqrt(v @ v)
            v[0] += np.copysign(length, v[0])
            v /= np.sqrt(v @ v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            q = p - (v @ p) * v
            rest -= 2 * (np.outer(v, q) + np.outer(q, v))
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each of ``x``: the negative terms of the Sturm sequence, kept off zero."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = np.finfo(float).eps * scale * 1e-3
    below = np.zeros(x.shape, int)
    q = np.ones(x.shape)
    for i, d in enumerate(diagonal):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bit that the matrix carries."""
    n = len(diagonal)
    radius = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    wanted = n - 1 - np.arange(k)  # so many are smaller
    for _ in range(120):
        middle = (low + high) / 2
        up = sturm_count(diagonal, off, middle) <= wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all(high - low <= np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; a pivot of zero becomes ``least``."""
    n = len(diagonal)
    d, up, far, below, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), np.append(off, 0.0), b.astype(float).copy()
    for i in range(n - 1):
        if abs(d[i]) < abs(below[i]):
            # the next row (below[i], d[i + 1], up[i + 1]) comes first
            d[i], below_i = below[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            far[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            below_i = below[i]
        if abs(d[i]) < least:
            d[i] = least
        f = below_i / d[i]
        d[i + 1] -= f * up[i]
        up[i + 1] -= f * far[i]
        x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        if abs(d[i]) < least:
            d[i] = least
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (far[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
        if abs(x[i]) > 1e150:  # only the direction counts
            x /= abs(x[i])
    return x / np.abs(x).max()


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A unit eigenvector, as a column, for each of the falling ``values``; those of a cluster are orthogonalised against each other."""
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least, close = np.finfo(float).eps * scale, 1e-3 * scale
    out = np.zeros((n, len(values)))
    first, used = 0, np.inf
    start = np.random.default_rng(12)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close:
            first = j
        used = min(value, used - 4 * least) if j > first else value  # equal values need different shifts
        own = out[:, first:j]
        x = start.uniform(0.5, 1.0, n) * start.choice([-1.0, 1.0], n)
        for _ in range(rounds):
            x = _solve(diagonal, off, used, x, least)
            for _ in range(2):  # twice is enough
                x = x - own @ (own.T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``a``, falling, and their unit vectors as columns."""
    size = np.abs(a).max(initial=0.0)
    if size == 0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    diagonal, off, reflections = householder(a / size)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values * size, vectors


# Over Spark.


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` has learnt: of ``n`` vectors the exact ``sums``, the components (columns), their eigenvalues and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there and holds numbers of the grid only."""
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return vectors.where(F.col(vec).isNotNull() & ~odd & (F.size(vec) > 0))


def dimension(vectors: DataFrame, vec: str) -> int | None:
    """The commonest length of a usable vector (ties: the least); null of an empty table."""
    found = _usable(vectors, vec).groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return found["d"] if found else None


def _grid(column: pa.Array | pa.ChunkedArray, d: int) -> Iterator[np.ndarray]:
    """The integer vectors of a batch's column, some rows at a time."""
    for start in range(0, len(column), ROWS):
        part = column.slice(start, ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        yield np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _partial(of, d: int, vec: str):
    """A function for mapInArrow that adds ``of(grid)`` up and puts the total out as rows (i, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _grid(batch.column(batch.schema.get_field_index(vec)), d):
                own = of(x)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], ["i", "values"])

    return run


def _total(parts: DataFrame, width: int) -> list:
    """Rows (i, values) of all tasks added up by i: at most one row an i comes to the driver."""
    sums = parts.groupBy("i").agg(*[F.sum(F.col("values")[k]).alias(f"v{k}") for k in range(width)])
    return [list(r)[1:] for r in sums.orderBy("i").collect()]


def fit(vectors: DataFrame, components: int = COMPONENTS, vec: str = "embedding") -> Whitening | None:
    """Mean, covariance and leading components of all usable vectors; null if there are none."""
    d = dimension(vectors, vec)
    if d is None:
        return None
    rows = _usable(vectors, vec).where(F.size(vec) == d).select(vec)
    # high and low parts in a line each, so that no sum passes 64 bits; the last number of either line is the count
    plain = lambda x: np.stack([np.append((x >> LOW).sum(axis=0), len(x)), np.append((x & ((1 << LOW) - 1)).sum(axis=0), len(x))])
    high, low = _total(rows.mapInArrow(_partial(plain, d, vec), "i int, values array<bigint>"), d + 1)
    sums, n = [(int(h) << LOW) + int(k) for h, k in zip(high[:-1], low[:-1], strict=True)], int(low[-1])
    mean = _Mean(sums, n)

    def products(x: np.ndarray) -> np.ndarray:
        c = mean.centred(x)
        return c.T @ c

    cov = np.array(_total(rows.mapInArrow(_partial(products, d, vec), "i int, values array<double>"), d), float) / n
    values, basis = leading_eigenpairs((cov + cov.T) / 2, min(components, d))
    kept = values > NOTHING * np.trace(cov)
    return Whitening(n, tuple(sums), values[kept], basis[:, kept], float(np.trace(cov)))


class _Mean:
    """Differences from the mean S / n of integer vectors, without loss: S / n is a whole number and a remainder."""

    def __init__(self, sums, n: int):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        far = x - self.whole
        most = (int(np.abs(far).max(initial=0)) + 1) * self.n
        if most < LONG and x.shape[1] * most**2 < LONG:
            y = far * self.n - self.rest
            return (y * y).sum(axis=1).tolist()
        y = far.astype(object) * self.n - self.rest.astype(object)
        return [sum(v * v for v in row) for row in y]


def whiten(vectors: DataFrame, model: Whitening | None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, component, deviation, whitened)``: a row for each usable vector of the model's length and component, from 1.

    ``deviation``, n^2 times the vector's squared distance from the mean, is null where it passes 64 bits.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, deviation long, whitened double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, k = _Mean(model.sums, model.n), len(model.values)
    turn = model.vectors / np.sqrt(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start = batch.column(0), 0
            for x in _grid(batch.column(1), len(model.sums)):
                out = mean.centred(x) @ turn
                deviation = [v if v < LONG else None for v in mean.deviation(x)]
                at = np.repeat(np.arange(len(x)), k)
                own = keys.slice(start, len(x)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(out.ravel())],
                    [key, "component", "deviation", "whitened"],
                )
                start += len(x)

    rows = _usable(vectors, vec).where(F.size(vec) == len(model.sums)).select(key, vec)
    return rows.mapInArrow(project, schema)


def identity_error(vectors: DataFrame, model: Whitening | None, vec: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of all whitened vectors, about their own mean, less the identity; null of no vectors."""
    if model is None or not len(model.values):
        return None
    mean, turn, k = _Mean(model.sums, model.n), model.vectors / np.sqrt(model.values), len(model.values)
    rows = _usable(vectors, vec).where(F.size(vec) == len(model.sums)).select(vec)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task's rows: count, mean and products about that mean, in one row."""
        n, centre, total = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _grid(batch.column(0), len(model.sums)):
                w = mean.centred(x) @ turn
                own = w.mean(axis=0)
                total += (w - own).T @ (w - own) + np.outer(own - centre, own - centre) * (n * len(w) / (n + len(w)))
                centre, n = centre + (own - centre) * (len(w) / (n + len(w))), n + len(w)
        if n:
            rows = np.concatenate([total, np.outer(centre, centre) * n, centre[None, :] * n])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows.tolist())], ["i", "values"])

    sums = np.array(_total(rows.mapInArrow(moments, "i int, values array<double>"), k), float)
    within, between, centre = sums[:k], sums[k : 2 * k], sums[2 * k] / model.n
    cov = (within + between) / model.n - np.outer(centre, centre)
    return float(np.abs(cov - np.eye(k)).max())


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of all usable vectors, over components from 1 up to ``components``.

    Vectors that are null or empty, hold a null, NaN, infinite or off-grid entry, or have another length than most, are
    left out. Repeated rows count as often as they occur and get equal answers; a row without key stays. Components
    without variance are not numbered, so a table of equal vectors, like an empty one, gives no rows. Signs of components are free.
    """
    model = fit(vectors, components, vec)
    out = whiten(vectors, model, vec, key)
    if model is None:
        n, share = F.lit(0).cast("long"), F.lit(None).cast("double")
    else:
        n, share = F.lit(model.n).cast("long"), F.lit([float(v) for v in model.values / model.trace] or [0.0])[F.col("component") - 1]
    error = F.lit(identity_error(vectors, model, vec)).cast("double")
    return out.select(key, "component", n.alias("n"), "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))
