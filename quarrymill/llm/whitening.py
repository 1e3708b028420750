"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

Components become whole numbers x = floor(SCALE * c). The fit list holds each distinct x vector once. Tasks add up exact sums of
x, then of products of x less the rounded mean, so the covariance is an exact fraction rounded once, whatever the partitions.
The number of eigenvalues above a shift is the number of positive pivots of the shifted covariance's LDL^T factors (inertia):
bisection by these counts isolates each leading eigenvalue, Rayleigh quotient iteration converges to it cubically, and two
more counts certify its number.

Defined results: a vector that is null, holds null or non-finite entries or an x beyond a long gives no row; a row without an
id is whitened like others; repeated rows count once in the fit and each give their rows; vectors of different lengths are fitted
apart, empty ones give no row; vectors with fewer dimensions than components give as many rows as they have dimensions; a
component without variance has whitened 0, and takes no part in identity_error; a deviation beyond a long is null; an empty
table gives an empty result; other columns are ignored.

The driver holds dim^2 numbers for each length of vectors, and nothing that grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, COMPONENTS = 256, 4
#: Numbers of a matrix that a task works on at a time, about.
RUN = 1 << 20
#: Exact sums travel as three parts to this base: any sum of up to 2**21 tasks fits.
_BASE = 42
_EPS = float(np.finfo(float).eps)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x array<long>, for the vectors that take part."""
    whole = lambda x: F.lit(float(scale)) * x.cast("double")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(whole(x)) < F.lit(2.0**63)))
    x = F.transform("embedding", lambda x: F.floor(whole(x)).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their vectors as a matrix) by length, in runs of a bounded size."""
    lists = batch.column("x")
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        step = max(1, RUN // int(dim))
        for first in range(0, len(own), step):
            rows = own[first : first + step]
            yield int(dim), rows, lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of whole numbers, exact: in floats where all partial sums are, else in longs, else in Python's integers."""
    if a.dtype != object and b.dtype != object:
        bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * len(a)
        if bound < 2**53:
            return (a.astype(float).T @ b.astype(float)).astype(np.int64).astype(object)
        if bound < 2**62:
            return (a.T @ b).astype(object)
    return a.astype(object).T @ b.astype(object)


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less whole numbers, exact."""
    if max(map(abs, centre), default=0) < 2**61 and np.abs(x.astype(float)).max(initial=0) < 2**61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _parts(total: dict[int, np.ndarray], rows: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Sums by length as rows: dim, i, j, n, and the three parts of the sum."""
    mask = (1 << _BASE) - 1
    for dim, sums in total.items():
        flat = [int(v) for v in sums.ravel()]
        i, j = np.divmod(np.arange(len(flat)), sums.shape[1])
        parts = [pa.array([v & mask for v in flat], pa.int64()), pa.array([(v >> _BASE) & mask for v in flat], pa.int64()), pa.array([v >> 2 * _BASE for v in flat], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(flat), rows[dim], np.int64)), *parts], ["dim", "i", "j", "n", "p0", "p1", "p2"])


def _sums(batches: Iterator[pa.RecordBatch], centres: dict[int, list[int]] | None) -> Iterator[pa.RecordBatch]:
    """Exact sums of one task's vectors; with centres, of the products of the centred components."""
    total, rows = {}, {}
    for batch in batches:
        for dim, own, x in _matrices(batch):
            if centres is None:
                made = _times(np.ones((len(x), 1), np.int64), x)
            else:
                z = _less(x, centres[dim])
                made = _times(z, z)
            total[dim], rows[dim] = total[dim] + made if dim in total else made, rows.get(dim, 0) + len(own)
    yield from _parts(total, rows)


def _collected(fit: DataFrame, centres: dict[int, list[int]] | None = None) -> tuple[dict[int, int], dict[int, list[list[int]]]]:
    """n and the exact sums by length: dim^2 numbers a length come to the driver."""
    made = fit.mapInArrow(lambda it: _sums(it, centres), "dim int, i int, j int, n long, p0 long, p1 long, p2 long")
    counts, sums = {}, {}
    for r in made.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2")]).collect():
        table = sums.setdefault(r["dim"], [[0] * r["dim"] for _ in range(1 if centres is None else r["dim"])])
        table[r["i"]][r["j"]], counts[r["dim"]] = r["p0"] + (r["p1"] << _BASE) + (r["p2"] << 2 * _BASE), r["n"]
    return counts, sums


def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, zero) eigenvalues of a symmetric matrix, from its LDL^T factors with complete pivoting (1x1 and 2x2 pivots)."""
    a, positive = a.copy(), 0
    floor = _EPS * np.abs(a).max(initial=0.0)
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        beside = np.abs(a - np.diag(np.diag(a)))
        q, r = divmod(int(beside.argmax()), len(a))
        if max(diagonal[p], beside[q, r]) <= floor:
            return positive, len(a)
        if diagonal[p] >= 0.64 * beside[q, r]:  # (1 + sqrt(17)) / 8, the choice that bounds growth
            positive += a[p, p] > 0
            pivots = [p]
        else:  # a 2x2 pivot of negative determinant: one eigenvalue of each sign
            positive += 1
            pivots = [q, r]
        rest = np.delete(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivots, pivots)], side.T)
        a = (a + a.T) / 2
    return positive, 0


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows.

    The largest entry of each vector is positive. Equal eigenvalues get any orthonormal vectors of their space.
    """
    size = len(v)
    norm = float(np.abs(v).sum(axis=1).max(initial=0.0))
    values, vectors = np.zeros(count), np.zeros((count, size))
    if norm == 0:
        return values, np.eye(count, size)
    tiny = 4 * size * _EPS * norm
    known: dict[float, int] = {-1.01 * norm: size, 1.01 * norm: 0}
    rng = np.random.default_rng(1)

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = inertia(v - shift * np.eye(size))[0]
        return known[shift]

    def solve(shift: float, right: np.ndarray) -> np.ndarray:
        for _ in range(3):
            try:
                return np.linalg.solve(v - shift * np.eye(size), right)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                shift += _EPS * norm
        return right

    def unit(x: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            x = x - vectors[:k].T @ (vectors[:k] @ x)
        return x / np.linalg.norm(x)

    for k in range(count):
        low = max(s for s, n in known.items() if n >= k + 1)
        high = min(s for s, n in known.items() if n <= k)
        while True:
            while not (above(low) == k + 1 and above(high) == k) and high - low > tiny:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k + 1 else (low, middle)
            x, value = unit(rng.standard_normal(size), k), (low + high) / 2
            for _ in range(3):  # inverse iteration brings the vector near the isolated eigenvalue's
                x = unit(solve(value, x), k)
            for _ in range(12):
                value = float(x @ v @ x)
                if np.linalg.norm(v @ x - value * x) <= size * _EPS * norm / 4:
                    break
                x = unit(solve(value, x), k)
            value = float(x @ v @ x)
            if low - tiny <= value <= high + tiny and above(value + tiny) <= k and above(value - tiny) >= k + 1:
                break  # the counts certify that this is eigenvalue k + 1
            if high - low <= tiny:
                break
            middle = (low + high) / 2  # the iteration left the interval: a narrower one starts nearer
            low, high = (middle, high) if above(middle) >= k + 1 else (low, middle)
        values[k], vectors[k] = value, x * np.sign(x[np.abs(x).argmax()])
    return values, vectors


@dataclass
class Model:
    """A length's fit: n vectors with sums S; axes [components, dim] are unit eigenvectors over sqrt(e), zero rows where e is 0."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """fit(x), distinct vectors -> a model for each length."""
    counts, sums = _collected(fit)
    centres = {dim: [(2 * s + counts[dim]) // (2 * counts[dim]) for s in rows[0]] for dim, rows in sums.items()}
    _, products = _collected(fit, centres)
    models = {}
    for dim, n in counts.items():
        total = sums[dim][0]
        left = [s - n * c for s, c in zip(total, centres[dim], strict=True)]
        v = np.array([[(n * products[dim][i][j] - left[i] * left[j]) / (n * n) for j in range(dim)] for i in range(dim)])
        e, vectors = leading(v, min(components, dim))
        trace = sum(n * products[dim][i][i] - left[i] * left[i] for i in range(dim)) / (n * n)
        live = e > dim * _EPS * trace
        axes = np.where(live[:, None], vectors / np.sqrt(np.where(live, e, 1.0))[:, None], 0.0)
        models[dim] = Model(n, total, np.array([s / n for s in total]), axes, np.where(live, e, 0.0) / (trace or 1.0))
    made = fit.mapInArrow(lambda it: _moments(it, models), "dim int, i int, j int, total double")
    for r in made.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():
        m, i, j = models[r["dim"]], r["i"], r["j"]
        if m.axes[i].any() and m.axes[j].any():
            m.identity_error = max(m.identity_error, abs(r["total"] / m.n - (i == j)))
    return models


def _moments(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the whitened components, which the centring gives a mean of 0."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in _matrices(batch):
            y = (x - models[dim].mean) @ models[dim].axes.T
            total[dim] = total.get(dim, 0.0) + y.T @ y
    for dim, t in total.items():
        i, j = np.divmod(np.arange(t.size), len(t))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t.ravel())], ["dim", "i", "j", "total"])


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, None beyond a long."""
    bound = m.n * float(np.abs(x.astype(float)).max(initial=0)) + float(max(map(abs, m.sums)))
    if bound * bound * x.shape[1] < 2**62:
        z = x * m.n - np.array(m.sums, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = x.astype(object) * m.n - np.array(m.sums, object)
    return [int(d) if d < 2**63 else None for d in (z * z).sum(axis=1)]


def _whitened(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows, x in _matrices(batch):
            m = models[dim]
            k = len(m.axes)
            y = (x - m.mean) @ m.axes.T
            ids = batch.column("vec_id").take(pa.array(np.repeat(rows, k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * k, m.n, np.int64)), pa.array(_deviation(x, m), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))]
            columns += [pa.array(y.ravel()), pa.array(np.tile(m.explained, len(rows))), pa.array(np.full(len(rows) * k, m.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector
    that takes part and each of its leading components."""
    rows = integer_vectors(vectors, scale)
    models = fit_models(written(rows.select("x").distinct(), "whitening"), components)
    return rows.mapInArrow(lambda it: _whitened(it, models), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
