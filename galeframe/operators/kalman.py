"""Local-level filter and smoother of a source's bias, parallel inside a site.

The recursion is sequential, but what a row does to a state is a small element
that composes with the next row's: five numbers (share, shift, spread, and the
slope and curvature of the likelihood of the observations as a function of the
level before them). So a site runs as

    one summary per block -> one short scan over the blocks -> one last pass

The scan gives every block the filter state before it and the likelihood of all
that follows it; the smoothed level joins the two. Tasks see one block of rows
or one row per block, and the result equals the row-by-row recursion.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.config import SITE, TS
from galeframe.operators.blocks import ROW, spread, with_row_number
from galeframe.operators.settle import settle

c = F.col
BLOCK_ROWS = 8_192
# Parameters used when a series is too short to choose any.
FALLBACK_Q, FALLBACK_R, FALLBACK_P0 = 1e-4, 0.5, 1.0
FITTED_P0 = 10.0


def _affine_scan(a: np.ndarray, b: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    """x[t] = a[t] x[t-1] + b[t] along the first axis, by doubling the reach of the composed maps."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a * start + b


def _variance_maps(seen: np.ndarray, q: np.ndarray | float, r: np.ndarray | float) -> tuple[np.ndarray, ...]:
    """Compositions, up to each row, of the maps p -> (a p + b) / (c p + d) that a row has on the variance.

    ``seen`` marks observed rows; with candidates q and r as vectors every entry is rows x candidates.
    """
    hit = seen.reshape(-1, *[1] * np.ndim(q))
    one = np.ones_like(hit * np.asarray(q, dtype=float))
    a, b, cc, d = np.where(hit, r * one, 1.0), np.where(hit, q * r * one, q * one), np.where(hit, one, 0.0), np.where(hit, (q + r) * one, 1.0)
    step = 1
    while step < len(a):
        now, old = [m[step:] for m in (a, b, cc, d)], [m[:-step] for m in (a, b, cc, d)]
        new = [now[0] * old[0] + now[1] * old[2], now[0] * old[1] + now[1] * old[3], now[2] * old[0] + now[3] * old[2], now[2] * old[1] + now[3] * old[3]]
        top = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))  # all are positive or zero
        for m, v in zip((a, b, cc, d), new):
            m[step:] = v / top
        step *= 2
    return a, b, cc, d


def _filter(y: np.ndarray, q, r, x, p) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filtered level and variance from a start state, the share of the start level in the end level, and the
    log-likelihood of the observed rows; q, r, x and p may be vectors of candidates."""
    seen = ~np.isnan(y)
    a, b, cc, d = _variance_maps(seen, q, r)
    ps = (a * p + b) / (cc * p + d)
    before = np.concatenate([np.broadcast_to(p, ps[:1].shape), ps[:-1]]) + q
    shape = (-1, *[1] * np.ndim(q))
    hit, values = seen.reshape(shape), np.where(seen, y, 0.0).reshape(shape)
    gain = np.where(hit, before / (before + r), 0.0)
    xs = _affine_scan(1.0 - gain, gain * values, x)
    error = values - np.concatenate([np.broadcast_to(x, xs[:1].shape), xs[:-1]])
    ll = -0.5 * np.where(hit, np.log(2.0 * math.pi * (before + r)) + error * error / (before + r), 0.0).sum(0)
    return xs, ps, np.prod(1.0 - gain, axis=0), ll


def _fields(df: DataFrame, names: Sequence[str], **doubles: None) -> T.StructType:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([T.StructField(n, kinds[n]) for n in names] + [T.StructField(n, T.DoubleType()) for n in doubles])


def _schema(df: DataFrame, names: Sequence[str], doubles: Sequence[str]) -> T.StructType:
    return _fields(df, names, **{n: None for n in doubles})


Element = tuple[np.ndarray, ...]  # share, shift, spread, slope, curvature


def _elements(y: np.ndarray, q, r) -> Element:
    """What each row does to the state before it; with candidates q and r as vectors every entry is rows x candidates."""
    seen = ~np.isnan(y).reshape(-1, *[1] * np.ndim(q))
    v = np.where(seen, np.nan_to_num(y).reshape(seen.shape), 0.0)
    both = q + r
    return (np.where(seen, r / both, 1.0), np.where(seen, q / both, 0.0) * v, np.where(seen, q * r / both, q), np.where(seen, v / both, 0.0), np.where(seen, 1.0 / both, 0.0))


def _compose(first: Element, then: Element) -> Element:
    """The element of two stretches, one after the other."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    d = 1.0 + c1 * j2
    return a2 * a1 / d, a2 * (b1 + c1 * e2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (e2 - j2 * b1) / d + e1, a1 * a1 * j2 / d + j1


def _suffixes(e: Element) -> Element:
    """The elements of each row and all rows after it, by doubling the reach of the composed stretches."""
    out, step = tuple(m.copy() for m in e), 1
    while step < len(out[0]):
        new = _compose(tuple(m[:-step] for m in out), tuple(m[step:] for m in out))
        for m, v in zip(out, new):
            m[:-step] = v
        step *= 2
    return out


def _whole(e: Element) -> Element:
    """The element of all rows: neighbours are composed pairwise until one is left."""
    while len(e[0]) > 1:
        odd = tuple(m[len(m) - len(m) % 2:] for m in e)
        e = _compose(tuple(m[:len(m) - len(m) % 2:2] for m in e), tuple(m[1::2] for m in e))
        e = tuple(np.concatenate([m, o]) for m, o in zip(e, odd))
    return tuple(m[0] for m in e)


def _follows(e: Element, slope, curvature) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of the observations from an element on, given that of those after it."""
    a, b, cc, eta, j = e
    d = 1.0 + cc * curvature
    return a * (slope - curvature * b) / d + eta, a * a * curvature / d + j


def _advance(e: Element, x, p) -> tuple[np.ndarray, np.ndarray]:
    """Level and variance after an element."""
    a, b, cc, eta, j = e
    d = 1.0 + p * j
    return a * (x + p * eta) / d + b, a * a * p / d + cc


def _scan_blocks(elements: list[Element], p0) -> list[tuple]:
    """For each block of a site in order: level and variance before it, slope and curvature of what follows it."""
    x, p, ahead = np.zeros_like(p0), p0, []
    for e in elements:
        ahead.append((x, p))
        x, p = _advance(e, x, p)
    slope = curvature = np.zeros_like(p0)
    after = []
    for e in reversed(elements):
        after.append((slope, curvature))
        slope, curvature = _follows(e, slope, curvature)
    return [(*u, *v) for u, v in zip(ahead, reversed(after))]


def _prepared(df: DataFrame, value: Column, params: DataFrame | None, block_rows: int) -> DataFrame:
    rows = with_row_number(df.withColumn("_y", value.cast("double")))
    rows = rows.withColumn("_blk", F.floor(c(ROW) / block_rows))
    if params is None:
        return rows.withColumns({"_q": F.lit(FALLBACK_Q), "_r": F.lit(FALLBACK_R), "_p0": F.lit(FALLBACK_P0)})
    given = params.select(SITE, c("q").alias("_q"), c("r").alias("_r"), c("p0").alias("_p0"))
    own = {"_q": FALLBACK_Q, "_r": FALLBACK_R, "_p0": FALLBACK_P0}
    return rows.join(given, SITE, "left").withColumns({n: F.coalesce(n, F.lit(v)) for n, v in own.items()})


def smooth_level(df: DataFrame, value: Column, *, params: DataFrame | None = None, out: str = "level", filtered: str | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smoothed local level of ``value`` per site (missing values allowed), and the filtered level when named.

    ``params`` holds site, q, r and p0; without it, and for sites it lacks, the fallback values apply.
    """
    rows = settle(_prepared(df, value, params, block_rows))
    blk = [SITE, "_blk"]
    small = rows.select(SITE, ROW, "_blk", "_y", "_q", "_r", "_p0")
    parts, state = ["a", "b", "c", "e", "j"], ["_x", "_p", "_slope", "_curvature"]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        f = pdf.iloc[0]
        whole = _whole(_elements(pdf["_y"].to_numpy(dtype=float), f["_q"], f["_r"]))
        return pd.DataFrame([{**{n: f[n] for n in blk}, "_p0": f["_p0"], **dict(zip(parts, map(float, whole)))}])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        found = _scan_blocks([tuple(v) for v in pdf[parts].to_numpy(dtype=float)], float(pdf["_p0"].iloc[0]))
        return pdf[blk].assign(**dict(zip(state, np.array(found, dtype=float).T)))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        f, y = pdf.iloc[0], pdf["_y"].to_numpy(dtype=float)
        xs, ps, _, _ = _filter(y, f["_q"], f["_r"], f["_x"], f["_p"])
        after = _follows(tuple(m[1:] for m in _suffixes(_elements(y, f["_q"], f["_r"]))), f["_slope"], f["_curvature"])
        slope, curvature = np.append(after[0], f["_slope"]), np.append(after[1], f["_curvature"])
        return pd.DataFrame({SITE: pdf[SITE].to_numpy(), ROW: pdf[ROW].to_numpy(), "_sm": (xs + ps * slope) / (1.0 + ps * curvature), "_fl": xs})
    maps = spread(small, *blk).groupBy(*blk).applyInPandas(summary, _schema(rows, blk, ["_p0", *parts]))
    states = settle(maps.groupBy(SITE).applyInPandas(scan, _schema(rows, blk, state)))
    done = spread(small.join(states, blk, "inner"), *blk).groupBy(*blk).applyInPandas(finish, _schema(rows, [SITE, ROW], ["_sm", "_fl"]))
    names = {"_sm": out, **({"_fl": filtered} if filtered else {})}
    joined = rows.join(done, [SITE, ROW], "inner").withColumns({n: c(v) for v, n in names.items()})
    return joined.drop("_sm", "_fl", ROW, "_blk", "_y", "_q", "_r", "_p0")


def bias_columns(df: DataFrame, *, forecast: str = "wind_speed_120m", reference: str = "era5_wind_speed_100m", params: DataFrame | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smoothed bias of the forecast against the reference, and the forecast without it."""
    out = smooth_level(df, c(forecast) - c(reference), params=params, out="ws120_bias_kalman_smooth", block_rows=block_rows)
    return out.withColumns({"ws120_kalman": c(forecast) - c("ws120_bias_kalman_smooth")})


# Candidate variances of level and observation.
Q_GRID = (1e-6, 1e-4, 1e-2, 1e-1, 1.0)
R_GRID = (0.1, 0.5, 2.0, 8.0, 32.0)


def likelihood_table(df: DataFrame, value: Column, *, fit_filter: Column | None = None, q_grid: Sequence[float] = Q_GRID,
                     r_grid: Sequence[float] = R_GRID, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Log-likelihood of every (q, r) candidate per site; blocks run side by side, candidates as one vector."""
    grid = list(itertools.product(q_grid, r_grid))
    q, r = np.array([g[0] for g in grid]), np.array([g[1] for g in grid])
    rows = df if fit_filter is None else df.filter(fit_filter)
    rows = with_row_number(rows.select(SITE, TS, value.cast("double").alias("_y"))).withColumn("_blk", F.floor(c(ROW) / block_rows)).drop(TS)
    blk = [SITE, "_blk"]
    rows = settle(rows)

    def arrays(*names: str) -> T.StructType:
        return T.StructType([T.StructField(n, T.LongType()) for n in blk] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])

    def one(pdf: pd.DataFrame, **values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([{**{n: pdf[n].iloc[0] for n in blk}, **values}])

    def stacked(pdf: pd.DataFrame, name: str) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=float) for v in pdf[name]])

    def series(pdf: pd.DataFrame) -> np.ndarray:
        return pdf.sort_values(ROW)["_y"].to_numpy(dtype=float)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return one(pdf, **dict(zip("abcej", _whole(_elements(series(pdf), q, r)))))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        found = _scan_blocks(list(zip(*(stacked(pdf, n) for n in "abcej"))), np.full_like(q, FITTED_P0))
        return pdf[blk].assign(_x=[f[0] for f in found], _p=[f[1] for f in found])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        y = series(pdf)
        ll = _filter(y, q, r, *(np.asarray(pdf[n].iloc[0], dtype=float) for n in ("_x", "_p")))[3]
        return one(pdf, ll=ll, n=np.full_like(q, float(np.sum(~np.isnan(y)))))
    maps = spread(rows, *blk).groupBy(*blk).applyInPandas(summary, arrays(*"abcej"))
    state = settle(maps.groupBy(SITE).applyInPandas(scan, arrays("_x", "_p")))
    parts = spread(rows.join(state, blk, "inner"), *blk).groupBy(*blk).applyInPandas(score, arrays("ll", "n"))
    flat = parts.select(SITE, F.posexplode(F.arrays_zip("ll", "n")).alias("_g", "_v"))
    named = flat.select(SITE, F.get(F.lit(q), c("_g")).alias("q"), F.get(F.lit(r), c("_g")).alias("r"), c("_v.ll").alias("ll"), c("_v.n").alias("n"))
    return named.groupBy(SITE, "q", "r").agg(F.sum("ll").alias("log_likelihood"), F.sum("n").cast("long").alias("n_observed"))


def choose_parameters(table: DataFrame, *, min_rows: int = 500) -> DataFrame:
    """Best candidate per site; series with fewer observed rows get the fallback values, which ``fitted`` tells."""
    best = table.groupBy(SITE).agg(F.max_by(F.struct("q", "r"), F.struct("log_likelihood", -c("q"), -c("r"))).alias("_b"), F.max("n_observed").alias("n_observed"))
    enough = c("n_observed") >= min_rows
    return best.select(SITE, "n_observed", enough.alias("fitted"), F.when(enough, c("_b.q")).otherwise(F.lit(FALLBACK_Q)).alias("q"),
                       F.when(enough, c("_b.r")).otherwise(F.lit(FALLBACK_R)).alias("r"),
                       F.when(enough, F.lit(FITTED_P0)).otherwise(F.lit(FALLBACK_P0)).alias("p0"))
