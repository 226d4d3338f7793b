"""Isotonic curves per group, fitted and applied without collecting a group's rows.

Fitting takes two pooling passes, whatever the data. Points are reduced to distinct
x and range-partitioned by (group, x); a task pools its stretch of an axis. A pooled
block is final if its mean lies above every mean that a stretch further left ends
with and below every mean that a stretch further right starts with: no average that
reaches it from outside can then violate the order. In a stretch the final blocks
follow each other, so what is left are open blocks around the borders of stretches;
the final ones keep the zones between them independent. Only open blocks are
shuffled again, and each zone is pooled as a stream.

The curve is looked up through a search tree: blocks are numbered along the axis,
``FAN`` of them share a leaf and ``FAN`` nodes share a parent, so every list is
bounded however crowded the axis is. A look-up is one equi-join a level.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.config import CAPACITY_MW
from galeframe.functions.nullsafe import join_null_safe
from galeframe.operators.settle import settle
from galeframe.session import prepare

_FAR = float("inf")
FAN = 64
PART = "part"  # stretch of the axis that a block belongs to; stretches of a group are numbered along it


Pooled = tuple[list[float], list[float], list[float], list[float]]  # x_lo, x_hi, w, s


def _pool(pooled: Pooled, pdf: pd.DataFrame) -> None:
    """Add sorted blocks and merge neighbours until their means do not decrease."""
    lo, hi, ww, ss = pooled
    for a, b, c, d in zip(*(pdf[n].to_numpy().tolist() for n in ("x_lo", "x_hi", "w", "s"))):
        while ww and ss[-1] * c >= d * ww[-1]:
            a, c, d = lo.pop(), c + ww.pop(), d + ss.pop()
            hi.pop()
        lo.append(a)
        hi.append(b)
        ww.append(c)
        ss.append(d)


def _frame(pooled: Pooled, keys: list[str], group: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(("x_lo", "x_hi", "w", "s"), pooled)))
    for k in keys:
        out[k] = group[k]
    return out[[*keys, "x_lo", "x_hi", "w", "s"]]


def _pool_stretch(keys: list[str]):
    """Pool a task's sorted blocks group by group; what is kept while reading is the current group's pooled blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, pooled = None, ([], [], [], [])
        for pdf in batches:
            for _, part in pdf.groupby(keys, sort=False, dropna=False):
                head = part.iloc[0]
                if group is not None and not all(head[k] == group[k] or (pd.isna(head[k]) and pd.isna(group[k])) for k in keys):
                    yield _frame(pooled, keys, group)
                    pooled = ([], [], [], [])
                group = head
                _pool(pooled, part)
        if group is not None:
            yield _frame(pooled, keys, group)
    return run


def _pooled(blocks: DataFrame, keys: list[str], *, schema) -> DataFrame:
    return blocks.sortWithinPartitions(*keys, "x_lo").mapInPandas(_pool_stretch(keys), schema)


def _borders(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """For each stretch of a group: the highest mean left of it, the lowest right of it, and the number of its left zone.

    One row for each stretch reaches the windows. A stretch divides the axis if the one lies below the other.
    """
    mean = F.col("s") / F.col("w")
    ends = blocks.groupBy(*keys, PART).agg(F.min("x_lo").alias("_x"), F.min(mean).alias("_first"), F.max(mean).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_x")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns({"_left": F.coalesce(F.max("_last").over(before), F.lit(-_FAR)),
                             "_right": F.coalesce(F.min("_first").over(after), F.lit(_FAR))})
    divides = (F.col("_left") < F.col("_right")).cast("long")
    return ends.select(*keys, PART, "_left", "_right", divides.alias("_divides"), F.coalesce(F.sum(divides).over(before), F.lit(0)).alias("_zone"))


def fit_isotonic(
    df: DataFrame, keys: Sequence[str], x: str, y: str, *, fit_filter: Column | None = None, min_rows: int | Column = 1,
    y_min: float = 0.0, y_max: float = CAPACITY_MW, stretches: int | None = None,
) -> DataFrame:
    """Blocks of the non-decreasing least-squares curve: keys, part, x_lo, x_hi, value, n_rows (of the block).

    ``fit_filter`` marks the rows allowed into the fit; groups with fewer than
    ``min_rows`` of them (a number or an expression of the keys) get no curve. The axis is cut into ``stretches``, by
    default the session's shuffle partitions; the result does not depend on it.
    """
    spark, keys, c = prepare(df.sparkSession), list(keys), F.col
    rows = df.filter(c(x).isNotNull() & c(y).isNotNull())
    if fit_filter is not None:
        rows = rows.filter(fit_filter)
    points = rows.groupBy(*keys, c(x).cast("double").alias("x_lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(c(y).cast("double")).alias("s"))
    points = points.select(*keys, "x_lo", c("x_lo").alias("x_hi"), "w", "s")
    parts = stretches or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(parts, *keys, "x_lo")
    # settled: the cuts of a range partitioning may differ when it is computed again
    blocks = settle(_pooled(ranged, keys, schema=points.schema).withColumn(PART, F.spark_partition_id()))
    placed = join_null_safe(blocks, _borders(blocks, keys), [*keys, PART])
    mean = c("s") / c("w")
    side = F.when(c("_divides") == 0, 0).when(mean <= c("_left"), 0).when(mean >= c("_right"), 2).otherwise(1)
    # zones and the final runs between them take turns along the axis
    placed = placed.withColumn(PART, 2 * c("_zone") + side).select(*keys, PART, "x_lo", "x_hi", "w", "s")
    zones = placed.filter(c(PART) % 2 == 0)
    zones = _pooled(zones.repartition(parts, *keys, PART), [*keys, PART], schema=placed.schema)
    blocks = placed.filter(c(PART) % 2 == 1).unionByName(zones)
    if isinstance(min_rows, Column) or min_rows > 1:
        total = blocks.groupBy(*keys).agg(F.sum("w").alias("_rows"))
        blocks = join_null_safe(blocks, total, keys).filter(c("_rows") >= min_rows)
    value = F.greatest(F.lit(float(y_min)), F.least(F.lit(float(y_max)), c("s") / c("w")))
    return blocks.select(*keys, PART, "x_lo", "x_hi", value.alias("value"), c("w").alias("n_rows"))


@dataclass(frozen=True)
class Segments:
    """Search tree over the blocks of curves: ``levels`` from the root down to the leaves, each by (keys, ``_node``)."""

    levels: tuple[DataFrame, ...]


def segments(curve: DataFrame, keys: Sequence[str]) -> Segments:
    """Search tree of each curve, ready for ``apply_isotonic``; a list holds at most ``FAN`` blocks or children."""
    keys, c = list(keys), F.col
    by_part, by_group = Window.partitionBy(*keys, PART).orderBy("x_lo"), Window.partitionBy(*keys).orderBy("_x")
    # neighbours and numbers across stretches: one row for each stretch reaches this window
    ends = curve.groupBy(*keys, PART).agg(F.min("x_lo").alias("_x"), F.min_by("value", "x_lo").alias("_y"), F.count(F.lit(1)).alias("_n"))
    ends = ends.withColumns({"_after_x": F.lead("_x").over(by_group), "_after_y": F.lead("_y").over(by_group),
                             "_before": F.sum("_n").over(by_group) - c("_n")})
    numbered = join_null_safe(curve, ends.drop("_x", "_y", "_n"), [*keys, PART]).withColumns({
        "_at": c("_before") + F.row_number().over(by_part) - 1,
        "next_x": F.coalesce(F.lead("x_lo").over(by_part), c("_after_x")), "next_y": F.coalesce(F.lead("value").over(by_part), c("_after_y"))})
    start = F.when(c("_at") > 0, c("x_lo")).otherwise(F.lit(-_FAR)).alias("x0")
    leaf = numbered.withColumn("_node", F.floor(c("_at") / FAN)).groupBy(*keys, "_node").agg(
        F.sort_array(F.collect_list(F.struct(start, "x_hi", "value", "next_x", "next_y"))).alias("_list"))
    levels = [settle(leaf)]
    while (levels[0].agg(F.max("_node")).first()[0] or 0) > 0:
        child = F.struct(F.get("_list", F.lit(0))["x0"].alias("x0"), c("_node").alias("child"))
        levels.insert(0, settle(levels[0].groupBy(*keys, F.floor(c("_node") / FAN).alias("_node")).agg(
            F.sort_array(F.collect_list(child)).alias("_list"))))
    return Segments(tuple(levels))


def _last_from(x: str) -> Column:
    """The last entry of a list that starts at or before ``x``; NULL for a missing ``x``."""
    here = F.filter("_list", lambda e: e.x0 <= F.col(x))
    return F.when(~F.isnan(x), F.get(here, F.size(here) - 1))


def apply_isotonic(df: DataFrame, curves: Segments, keys: Sequence[str], outs: Mapping[str, str]) -> DataFrame:
    """Curve values by linear interpolation, constant outside the fitted range; NULL without a curve.

    ``outs`` maps each new column to its x. Curves of one leaf answer all of them from one join.
    """
    keys = list(keys)

    def value(x: str) -> Column:
        e = F.col(f"_e_{x}")
        slope = F.try_divide(e["next_y"] - e["value"], e["next_x"] - e["x_hi"])
        flat = (F.col(x) <= e["x_hi"]) | e["next_x"].isNull()
        return F.when(flat, e["value"]).otherwise(e["value"] + (F.col(x) - e["x_hi"]) * slope)
    xs = list(dict.fromkeys(outs.values()))
    if len(curves.levels) == 1:
        found = df.join(curves.levels[0].drop("_node"), keys, "left").withColumns({f"_e_{x}": _last_from(x) for x in xs}).drop("_list")
    else:
        found = df
        for x in xs:
            found = found.withColumn("_node", F.lit(0).cast("long"))
            for table in curves.levels:
                found = found.join(table, [*keys, "_node"], "left").withColumn(f"_e_{x}", _last_from(x)).drop("_list")
                if table is not curves.levels[-1]:
                    found = found.withColumn("_node", F.col(f"_e_{x}")["child"])
            found = found.drop("_node")
    return found.withColumns({out: value(x) for out, x in outs.items()}).drop(*[f"_e_{x}" for x in xs])
