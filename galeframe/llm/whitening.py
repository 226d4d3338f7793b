"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps a spectrum of the rows it has seen: their number, mean, the eigenvalues of their centred scatter and the
eigenvectors. A centred row is one rank-one update: the new eigenvalues are the roots of a secular equation between the old
ones, after directions the row does not touch and equal eigenvalues have been deflated. Batches of more rows than dimensions
are updated by the rows of their triangular factor, which have the same scatter. The spectra of tasks are
combined group by group: each eigenpair of one is a rank-one update of the other, and so is the distance of the means.
What comes out is refined by Rayleigh-Ritz steps: one pass over all rows gives the covariance in the basis found, whose
small eigenproblem turns the basis, until the turned basis leaves next to nothing beside the diagonal.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, small_batches, stash

#: Where a zero component lies after scaling, and the factor of the scaling.
ZERO, SCALE = 1_000_000, 64
BLOB = "part long, data binary"
EPS = float(np.finfo(float).eps)


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows without a null or non-finite component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    usual = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & usual)


def scaled(column: pa.Array, dims: int) -> np.ndarray:
    """floor(64 c) + 1,000,000 of each component as long integers; shorter vectors go on with zeros, and what does not fit
    into 62 bits ends there."""
    out = np.full((len(column), dims), ZERO, np.int64)
    lengths = np.diff(np.asarray(column.offsets))
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
    inside = np.arange(dims) < lengths[:, None]
    out[inside] = np.clip(np.floor(SCALE * values), -(2.0**61), 2.0**61).astype(np.int64) + ZERO
    return out


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) = 0 for ascending, distinct d and positive z2: the nearer pole of each root and the
    root's distance from it. All roots are found side by side, each within its own two poles."""
    n = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    half = 1.0 + (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    left = half >= 0
    left[-1] = True
    near = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d - d[near][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    to_left, to_right = d - d[near], upper - d[near]
    at = np.arange(n)  # roots still sought
    below = (at <= at[:, None]).astype(float)
    for _ in range(60):
        y = x[at]
        inverse = 1.0 / (delta[at] - y[:, None])
        f, f_below = 1.0 + inverse @ z2, (inverse * below[at]) @ z2
        slope = inverse * inverse
        low[at], high[at] = np.where(f < 0, y, low[at]), np.where(f < 0, high[at], y)
        lo, hi = low[at], high[at]
        done = np.abs(f) <= 16 * n * EPS * (f - 2 * f_below)
        done |= hi - lo <= 4 * EPS * np.maximum(np.abs(lo), np.abs(hi))
        if done.all():
            break
        # One pole on either side stands for all poles of that side, with the same value and slope.
        a, b = to_left[at] - y, to_right[at] - y
        rise, psi = slope @ z2, (slope * below[at]) @ z2
        c = f - a * psi - b * (rise - psi)
        p = (a + b) * f - a * b * rise
        root = np.sqrt(np.maximum(p * p - 4 * a * b * f * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = y + np.where(p <= 0, (p - root) / (2 * c), 2 * a * b * f / (p + root))
        x[at] = np.where(done, y, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
        at = at[~done]
    return near, x


def rank_one(d: np.ndarray, u: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of u diag(d) u' + rho v v', rho not negative."""
    z = u.T @ v * np.sqrt(rho)
    size = max(float(np.abs(d).max(initial=0.0)), float(z @ z))
    tol = 8 * EPS * size
    if size == 0.0:
        return d, u
    # Equal eigenvalues: turn their plane so that only one of them meets the row.
    for i in np.flatnonzero(np.diff(d) <= tol):
        r = float(np.hypot(z[i], z[i + 1]))
        if r > 0.0:
            c, s = z[i + 1] / r, z[i] / r
            u[:, i], u[:, i + 1] = c * u[:, i] - s * u[:, i + 1], s * u[:, i] + c * u[:, i + 1]
            z[i], z[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)
    if not len(live):
        return d, u
    dl, zl = d[live], z[live]
    # Turned neighbours may leave equal poles with a row part each; a hair's breadth apart they are poles of their own.
    dl = np.maximum.accumulate(np.maximum(dl, np.append(dl[:1], dl[:-1] + EPS * size)))
    near, x = roots(dl, zl * zl)
    apart = (dl - dl[near][:, None]) - x[:, None]  # row j: d - root j, without cancellation
    apart = np.where(apart == 0.0, -EPS * EPS * size, apart)
    # The row for which these roots are exact (Loewner's formula); its eigenvectors are orthogonal whatever the roots' rounding.
    between = dl - dl[:, None]
    np.fill_diagonal(between, 1.0)
    quotient = -apart.T / between.T  # [i, j]: (root j - d i) / (d j - d i)
    own = -np.diagonal(apart)
    np.fill_diagonal(quotient, 1.0)
    fitted = np.sqrt(np.abs(quotient.prod(1) * own)) * np.where(zl < 0, -1.0, 1.0)
    w = fitted / apart
    w /= np.sqrt(np.square(w).sum(1))[:, None]
    u[:, live] = u[:, live] @ w.T
    d = d.copy()
    d[live] = dl[near] + x
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Number, mean, eigenvalues of the centred scatter (ascending) and eigenvectors of the rows seen."""

    def __init__(self, n: float, mean: np.ndarray, d: np.ndarray, u: np.ndarray):
        self.n, self.mean, self.d, self.u = n, mean, d, u

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0.0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """Rows, each an update about their mean, and one update for the way of that mean.

        More rows than dimensions are first turned into the triangle of the same scatter, so a batch costs as many updates
        as there are dimensions.
        """
        mean = x.mean(0)
        rows = x - mean
        for row in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
            self.d, self.u = rank_one(self.d, self.u, 1.0, row)
        self.move(mean, float(len(x)))

    def move(self, mean: np.ndarray, n: float) -> None:
        """``n`` rows about ``mean`` came in: the distance of the means is an update of its own."""
        away, total = mean - self.mean, self.n + n
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, self.n * n / total, away)
        self.mean = self.mean + away * (n / total)
        self.n = total

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.d, other.u.T):
            if value > 0.0:
                self.d, self.u = rank_one(self.d, self.u, float(value), vector)
        self.move(other.mean, other.n)


def folded(parts: DataFrame, fn: Callable[[list[bytes]], bytes], fan: int = 8) -> bytes:
    """One blob from all of (part, data), ``fan`` at a time, round by round; each round is written."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan], "data": [fn(list(group.sort_values("part")["data"]))]})

    at = stash(parts)
    largest = at.agg(F.max("part")).first()[0]
    while largest > 0:
        at = stash(at.groupBy((F.col("part") / fan).cast("long").alias("_to")).applyInPandas(run, BLOB))
        largest //= fan
    return bytes(at.first()["data"])


def fan_of(dims: int, limit: int = 64 << 20) -> int:
    """How many square matrices are summed at a time: at most 64, and no more than ``limit`` bytes of them."""
    return max(2, min(64, limit // (8 * dims * dims)))


def sum_blobs(blobs: list[bytes]) -> bytes:
    first, *rest = (unpacked(b) for b in blobs)
    for r in rest:
        first = {k: first[k] + r[k] for k in first}
    return packed(**first)


def per_task(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray] | None]) -> DataFrame:
    """(part, data): what ``fn`` makes of each task's rows, tasks without rows left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        part = first.column("_part")[0].as_py()

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches
        yield {"part": [part], "data": [packed(**fn(every()))]}
    return map_batches(rows.withColumn("_part", F.spark_partition_id().cast("long")), run, BLOB)


def spectrum_of(rows: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all rows, moved by -1,000,000."""
    def grow(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        own = Spectrum.empty(dims)
        for batch in batches:
            own.add((scaled(batch.column("v"), dims) - ZERO).astype(float))
            own.u = np.linalg.qr(own.u)[0]  # rounding of many turns
        return {"n": np.array(own.n), "mean": own.mean, "d": own.d, "u": own.u}

    def combine(blobs: list[bytes]) -> bytes:
        first, *rest = (Spectrum(float(b["n"]), b["mean"], b["d"], b["u"]) for b in map(unpacked, blobs))
        for r in rest:
            first.merge(r)
        return packed(n=np.array(first.n), mean=first.mean, d=first.d, u=np.linalg.qr(first.u)[0])

    b = unpacked(folded(per_task(rows, grow), combine))
    return Spectrum(float(b["n"]), b["mean"], b["d"], b["u"])


def centred(batch: pa.RecordBatch, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole parts leave before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (scaled(batch.column("v"), dims) - whole).astype(float) - rest


def covariance(rows: DataFrame, basis: np.ndarray, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of all rows in the columns of ``basis``, divisor n."""
    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            y = centred(batch, dims, n, sums) @ basis
            total += y.T @ y
        return {"total": total}
    return unpacked(folded(per_task(rows, run), sum_blobs, fan_of(dims)))["total"] / n


def whiten(vectors: DataFrame, *, components: int = 32, tolerance: float = 1e-13, most_steps: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component.

    Vectors that are null or hold a null or non-finite component are left out; a row without an id stays, with a null id, and
    repeated rows count and come back as often as they occur. Shorter vectors go on with zeros, so an empty one is all zeros.
    There are as many components as dimensions where these are fewer. A component without variance (eigenvalue under 1e-12
    of the largest) has a null ``whitened`` and is left out of ``identity_error``. ``deviation`` is null beyond 64 bits.
    An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stash(usable(vectors, vec_id=vec_id, vector=vector))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = int(told["n"]), int(told["dims"] or 0)
    if not dims:
        return nothing

    def add(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        # Two halves of 32 bits each, so that sums of many large numbers stay whole.
        total = np.zeros((2, dims), np.int64)
        for batch in batches:
            x = scaled(batch.column("v"), dims)
            total += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        return {"total": total}
    high, low = unpacked(folded(per_task(rows, add), sum_blobs, fan_of(dims)))["total"]
    sums = [(int(a) << 32) + int(b) for a, b in zip(high, low)]

    basis = spectrum_of(rows, dims).u[:, ::-1]
    for _ in range(most_steps):
        small = covariance(rows, np.ascontiguousarray(basis), dims, n, sums)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        values = np.maximum(values[::-1], 0.0)
        beside = np.abs(small - np.diag(np.diagonal(small))).max()
        if beside <= tolerance * values[0]:  # the basis before this turn was as good already
            break
    k = min(components, dims)
    trace, live = float(values.sum()), values[:k] > 1e-12 * values[0]
    turned = basis[:, :k] * np.where(live, 1.0 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    left = covariance(rows, turned, dims, n, sums)[np.ix_(live, live)]
    error = float(np.abs(left - np.eye(int(live.sum()))).max(initial=0.0))
    explained = values[:k] / trace if trace else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = scaled(batch.column("v"), dims)
            out = centred(batch, dims, n, sums) @ turned
            away = n * np.abs(x.astype(float) - np.array(sums, float) / n).max(initial=0.0) + n
            if away * away * dims < 2.0**62 and n * float(np.abs(x).max()) < 2.0**62:
                deviation = np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
            else:
                whole = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
                deviation = [d if d < 2**63 else None for d in whole]
            m = len(out)
            yield {"vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                   "n": np.full(m * k, n), "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                   "whitened": pa.array(out.ravel(), mask=np.tile(~live, m)), "explained": np.tile(explained, m), "identity_error": np.full(m * k, error)}

    return map_batches(rows, project, nothing.schema)
