"""Forecast smoothing along time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.config import DEFAULT, SITE, FarmConfig
from galeframe.functions.nullsafe import clip
from galeframe.operators.settle import settle
from galeframe.operators.blocks import BLOCK, BLOCK_ROWS, OWN, ROW, run_blocked, spread, with_blocks, with_row_number

c = F.col

# Least-squares weights of a quadratic over five points, at the centre and at the first two points.
CENTRE = (-3, 12, 17, 12, -3)
FIRST = (31, 9, -3, -5, 3)
SECOND = (9, 13, 12, 6, -5)


def _sized(df: DataFrame) -> DataFrame:
    """Row position and series length per site."""
    n = settle(df.groupBy(SITE).agg(F.count(F.lit(1)).alias("_len")))
    return with_row_number(df).join(n, SITE, "inner")


def quadratic_smooth(df: DataFrame, *, pred: str, out: str = "smooth_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Five-point quadratic smoothing with fitted edges; series under five rows pass through."""
    def weighted(w, offsets, weights) -> Column:
        total = None
        for o, k in zip(offsets, weights):
            v = c(pred) if o == 0 else (F.lead(pred, o).over(w) if o > 0 else F.lag(pred, -o).over(w))
            total = v * k if total is None else total + v * k
        return total / 35.0

    def build(w):
        from_end = c("_len") - 1 - c(ROW)
        value = (F.when(c("_len") < 5, c(pred))
                 .when(c(ROW) == 0, weighted(w, range(0, 5), FIRST)).when(c(ROW) == 1, weighted(w, range(-1, 4), SECOND))
                 .when(from_end == 0, weighted(w, range(0, -5, -1), FIRST)).when(from_end == 1, weighted(w, range(1, -4, -1), SECOND))
                 .otherwise(weighted(w, range(-2, 3), CENTRE)))
        return [{"_smooth": value}]
    done = run_blocked(_sized(df), build, back=4, ahead=4)
    return done.withColumns({out: clip("_smooth", 0.0, cfg.capacity_mw)}).drop("_smooth", "_len")


def rolling_median(df: DataFrame, *, pred: str, rows: Sequence[int] = (3, 5, 7), out: str = "median_{}_mw") -> DataFrame:
    """Centred medians of odd numbers of rows, the series reflected at both ends; all widths share one pass."""
    widest = max(rows) // 2

    def build(w):
        return [{f"_near{n}": F.collect_list(pred).over(w.rowsBetween(-(n // 2), n // 2)) for n in rows}]
    done = run_blocked(_sized(df), build, back=widest, ahead=widest, keep_row=True)

    def median(n: int) -> Column:
        pad, near = n // 2, c(f"_near{n}")
        short_head = F.greatest(F.lit(0), pad - c(ROW)).cast("int")
        short_tail = F.greatest(F.lit(0), c(ROW) + pad - (c("_len") - 1)).cast("int")
        head = F.slice(near, F.lit(2), short_head)
        tail = F.slice(near, F.greatest(F.lit(1), F.size(near) - short_tail), short_tail)
        full = F.array_sort(F.concat(near, head, tail))
        return F.when(c("_len") <= pad, c(pred)).otherwise(F.get(full, F.lit(pad)))
    return done.withColumns({out.format(n): median(n) for n in rows}).drop(*[f"_near{n}" for n in rows], "_len", ROW)


def _reach(span: int) -> int:
    """Rows after which a start value's weight is below the resolution of a double."""
    alpha = 2.0 / (span + 1)
    return 0 if alpha >= 1.0 else math.ceil(60 * math.log(2.0) / -math.log1p(-alpha))


def exponential_smooth(df: DataFrame, *, pred: str, span: int, out: str = "ema_mw", both: str | None = None, block_rows: int = 10 * BLOCK_ROWS) -> DataFrame:
    """Exponential mean along time and, when ``both`` is named, the average with the mean run backwards.

    A block starts from the rows before it, far enough back that their start
    value no longer changes a double; so blocks are independent and bounded.
    """
    alpha, reach = 2.0 / (span + 1), _reach(span)
    base = with_row_number(df)
    blocks = with_blocks(base, back=reach, ahead=reach if both else 0, block_rows=block_rows)
    names = [out, *([both] if both else [])]
    schema = T.StructType([T.StructField(SITE, T.LongType()), T.StructField(ROW, T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW)
        own = pdf[OWN].to_numpy()
        fwd = pdf[pred].ewm(alpha=alpha, adjust=False).mean()
        res = pd.DataFrame({SITE: pdf[SITE].to_numpy(), ROW: pdf[ROW].to_numpy(), out: fwd.to_numpy()})
        if both:
            back = pdf[pred][::-1].ewm(alpha=alpha, adjust=False).mean()[::-1]
            res[both] = (fwd.to_numpy() + back.to_numpy()) / 2.0
        return res[own]
    smooth = spread(blocks.select(SITE, BLOCK, ROW, OWN, c(pred).cast("double").alias(pred)), SITE, BLOCK).groupBy(SITE, BLOCK).applyInPandas(run, schema)
    return base.join(smooth, [SITE, ROW], "inner").drop(ROW)


