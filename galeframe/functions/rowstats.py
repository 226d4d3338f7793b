"""Statistics across the columns of one row, skipping NULLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.nullsafe import col


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def present_count(cols: Sequence[str | Column]) -> Column:
    return _sum([col(c).isNotNull().cast("int") for c in cols])


def row_mean(cols: Sequence[str | Column]) -> Column:
    total = _sum([F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.try_divide(total, present_count(cols).cast("double"))


def row_std(cols: Sequence[str | Column], ddof: int = 0) -> Column:
    """Two-pass standard deviation; NULL when fewer than ``ddof + 1`` values are present."""
    mean = row_mean(cols)
    sq = _sum([F.coalesce((col(c) - mean) * (col(c) - mean), F.lit(0.0)) for c in cols])
    n = present_count(cols)
    return F.when(n > ddof, F.sqrt(F.try_divide(sq, (n - ddof).cast("double"))))


def row_min(cols: Sequence[str | Column]) -> Column:
    return F.least(*[col(c) for c in cols])


def row_max(cols: Sequence[str | Column]) -> Column:
    return F.greatest(*[col(c) for c in cols])


def row_range(cols: Sequence[str | Column]) -> Column:
    return row_max(cols) - row_min(cols)


def row_median(cols: Sequence[str | Column]) -> Column:
    ordered = F.array_sort(F.array_compact(F.array(*[col(c).cast("double") for c in cols])))
    n = present_count(cols)
    lo = F.floor((n + 1) / 2).cast("int")
    hi = F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(ordered, lo) + F.try_element_at(ordered, hi)) / 2.0)


def row_rank(target: str | Column, cols: Sequence[str | Column], position: int) -> Column:
    """Zero-based rank of ``cols[position]`` among ``cols``.

    A NULL takes the row median; ties go to the earlier column.
    """
    med = row_median(cols)
    filled = [F.coalesce(col(c), med) for c in cols]
    me = F.coalesce(col(target), med)
    terms = []
    for i, v in enumerate(filled):
        if i == position:
            continue
        before = v <= me if i < position else v < me
        terms.append(before.cast("int"))
    return _sum(terms)
