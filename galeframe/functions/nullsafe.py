"""NULL-safe column helpers.

Spark's ``least``/``greatest`` skip NULLs and ANSI division raises on zero, so
clipping, division and binning all go through the helpers below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(df: DataFrame, *names: str) -> bool:
    """True when every named column exists (a driver-side check, no job)."""
    present = set(df.columns)
    return all(n in present for n in names)


def evaluate_once(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    Going through a one-element generator keeps the optimizer from copying the
    expression into every later filter and projection that reads the column.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def clip(x: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Limit ``x`` to [lo, hi]; NULL stays NULL."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def div(a: str | Column, b: str | Column) -> Column:
    """``a / b`` with NULL instead of an error when ``b`` is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate over the rows where both are present; NULL when either does not vary."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def flag(cond: Column) -> Column:
    """0/1 integer flag; an undecidable condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def zero_if_null(x: str | Column, value: float = 0.0) -> Column:
    return F.coalesce(col(x), F.lit(value))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where a missing key equals a missing key; the keys of the left side stay."""
    marked = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    cond = left[keys[0]].eqNullSafe(marked[f"{keys[0]}__r"])
    for k in keys[1:]:
        cond = cond & left[k].eqNullSafe(marked[f"{k}__r"])
    return left.join(marked, cond, how).drop(*[f"{k}__r" for k in keys])


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Map NaN to NULL in floating columns so every operator sees one kind of missing."""
    kinds = {"double", "float"}
    names = [n for n, t in df.dtypes if t in kinds and (cols is None or n in cols)]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def bin_left_closed(x: str | Column, edges: Sequence[float], *, clamp: bool) -> Column:
    """Index of the bin [e_i, e_{i+1}) holding ``x``.

    With ``clamp`` values outside the edges go to the first or last bin,
    otherwise they give NULL.
    """
    x = col(x)
    last = len(edges) - 2
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    if clamp:
        for i in range(last):
            out = out.when(x < F.lit(float(edges[i + 1])), F.lit(i))
        return out.otherwise(F.lit(last))
    out = out.when(x < F.lit(float(edges[0])), F.lit(None).cast("int"))
    for i in range(last + 1):
        out = out.when(x < F.lit(float(edges[i + 1])), F.lit(i))
    return out


def bin_right_closed(x: str | Column, edges: Sequence[float], *, include_lowest: bool = False) -> Column:
    """Index of the bin (e_i, e_{i+1}] holding ``x``; outside values give NULL."""
    x = col(x)
    first = F.lit(float(edges[0]))
    below = x < first if include_lowest else x <= first
    out = F.when(x.isNull() | below, F.lit(None).cast("int"))
    for i in range(len(edges) - 1):
        out = out.when(x <= F.lit(float(edges[i + 1])), F.lit(i))
    return out


def bin_even(x: str | Column, width: float, lo: int, hi: int) -> Column:
    """``floor(x / width)`` limited to [lo, hi]."""
    x = col(x)
    return F.when(
        x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(x / F.lit(float(width))).cast("int")))
    )


def sector_wrapped(deg: str | Column, n: int) -> Column:
    """Direction sector with 360 degrees wrapping to sector 0 (used when fitting)."""
    return F.pmod(F.floor(col(deg) / F.lit(360.0 / n)).cast("int"), F.lit(n))


def sector_clamped(deg: str | Column, n: int) -> Column:
    """Direction sector with 360 degrees in the last sector (used as a feature); NULL gives 0."""
    s = F.floor(col(deg) / F.lit(360.0 / n)).cast("int")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(n - 1), s)), F.lit(0))


def circular_difference_deg(a: str | Column, b: str | Column) -> Column:
    """Signed angle a - b in (-180, 180] degrees."""
    d = F.radians(col(a) - col(b))
    return F.atan2(F.sin(d), F.cos(d)) * F.lit(180.0 / math.pi)


def unit_dot(sa: str | Column, ca: str | Column, sb: str | Column, cb: str | Column) -> Column:
    """Cosine between two unit vectors given as (sin, cos), limited to [-1, 1]."""
    return clip(col(sa) * col(sb) + col(ca) * col(cb), -1.0, 1.0)
