"""Analog forecasts: the most similar past hours of a site.

Exact nearest rows with pruning: the training rows of a key lie in k-d cells,
cut level by level at quantiles of the coordinate that varies most in a cell
until a cell holds few rows. A scoring row first meets its own cell, whose k-th
distance bounds the search, then the nearest other cells, which tighten it, and
last the cells whose bounding boxes are still no farther. Boxes are found by
going down the tree, so cells out of reach are never paired with a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.config import DEFAULT, PRESSURE, SITE, TS, FarmConfig
from galeframe.functions.nullsafe import clip, div
from galeframe.operators.blocks import spread
from galeframe.operators.settle import settle

c = F.col

BLOCK_ROWS = 2_000
SLICE_ROWS = 20_000  # scoring rows that meet a block in one task
PARTS = 8  # children of a cell that is split
MAX_LEVELS = 20
FIRST_CELLS = 4  # other cells visited before the bound is taken again
_QUERY_STEP = 256


def weather_features() -> dict[str, Column]:
    """Weather and hour coordinates of an analog search."""
    angle = F.hour(TS) * (2.0 * math.pi / 24.0)
    return {"f_ws120": c("wind_speed_120m") * 3.0, "f_ws80": c("wind_speed_80m"), "f_ws10": c("wind_speed_10m"), "f_temp": c("temperature_80m"),
            "f_pressure": c(PRESSURE) / 100.0, "f_gust": c("wind_gusts_10m"), "f_sin": F.sin(angle), "f_cos": F.cos(angle)}


def usable_history(target: str, wind: str = "wind_speed_120m", cfg: FarmConfig = DEFAULT) -> Column:
    """Plausible power, and no near-zero power in strong wind."""
    y = c(target)
    return y.isNotNull() & (y >= 0) & (y <= cfg.capacity_mw) & ~F.coalesce((c(wind) > 8) & (y < 5), F.lit(False))


def scaled(train: DataFrame, score: DataFrame, features: dict[str, Column], keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with the features standardised by the training rows of their key.

    Only complete rows can be searched or found; callers join the result to their own rows.
    """
    names = list(features)
    complete = None
    for n in names:
        complete = c(n).isNotNull() if complete is None else complete & c(n).isNotNull()
    train, score = train.withColumns(features).filter(complete), score.withColumns(features).filter(complete)
    stats = train.groupBy(*keys).agg(*[e for n in names for e in (F.avg(n).alias(f"{n}_m"), F.stddev_pop(n).alias(f"{n}_s"))])
    stats = settle(stats)
    drop = [x for n in names for x in (f"{n}_m", f"{n}_s")]

    def apply(df: DataFrame) -> DataFrame:
        joined = df.join(stats, list(keys), "inner")
        return joined.withColumns({n: (c(n) - c(f"{n}_m")) / F.when(c(f"{n}_s") > 0, c(f"{n}_s")).otherwise(F.lit(1.0)) for n in names}).drop(*drop)
    return apply(train), apply(score), names


def _closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``x`` and distances of the k nearest rows of each row of ``y``; ties to earlier rows of ``x``."""
    k = min(k, len(x))
    rows, dist = np.empty((len(y), k), np.int64), np.empty((len(y), k))
    for start in range(0, len(y), _QUERY_STEP):
        part = y[start:start + _QUERY_STEP]
        d = np.zeros((len(part), len(x)))
        for j in range(x.shape[1]):
            d += (part[:, j:j + 1] - x[:, j]) ** 2
        limit = np.partition(d, k - 1, axis=1)[:, k - 1:k]
        who, near = np.nonzero(d <= limit)  # at least k of each row, more where several equal the limit
        near_d = d[who, near]
        order = np.lexsort((near, near_d, who))
        first = np.searchsorted(who, np.arange(len(part)))
        order = order[first[:, None] + np.arange(k)]
        rows[start:start + len(part)] = near[order]
        dist[start:start + len(part)] = np.sqrt(near_d[order])
    return rows, dist


def _cells(table: DataFrame, splits: Sequence[DataFrame], keys: list[str], features: list[str]) -> DataFrame:
    """``_cell`` of each row and ``_path``, the cells it lies in from the whole key down; a cell that is not split stands for itself."""
    out = table.withColumns({"_cell": F.lit(0).cast("long"), "_path": F.array(F.lit(0).cast("long"))})
    for split in splits:
        value = F.element_at(F.array(*features), c("_dim"))
        part = F.size(F.filter("_cuts", lambda x: x <= value)).cast("long")
        out = out.join(split, [*keys, "_cell"], "left").withColumn("_cell", F.when(c("_cuts").isNull(), c("_cell")).otherwise(c("_cell") * PARTS + 1 + part))
        out = out.withColumn("_path", F.concat("_path", F.array("_cell"))).drop("_dim", "_cuts")
    return out


def _splits(table: DataFrame, keys: list[str], features: list[str], cell_rows: int) -> list[DataFrame]:
    """Cuts of the k-d cells, one written table for each level: keys, _cell, _dim (from 1), _cuts.

    A cell of more than ``cell_rows`` rows is cut into up to ``PARTS`` at quantiles of the coordinate that varies most in
    it, or at the mean where all quantiles are the lowest value. Rows equal in every coordinate stay together.
    """
    spreads = F.array_max(F.array(*[F.struct(F.stddev_pop(n).alias("sd"), F.lit(i + 1).alias("dim")) for i, n in enumerate(features)]))
    out: list[DataFrame] = []
    while len(out) < MAX_LEVELS:
        placed = _cells(table, out, keys, features)
        sizes = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
        if (sizes or 0) <= cell_rows:
            break
        large = settle(placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), spreads.alias("_s")).filter((c("_n") > cell_rows) & (c("_s.sd") > 0))
                       .select(*keys, "_cell", "_n", c("_s.dim").alias("_dim")))
        if large.isEmpty():
            break
        values = placed.join(large, [*keys, "_cell"], "inner").withColumn("_v", F.element_at(F.array(*features), c("_dim")))
        marks = values.groupBy(*keys, "_cell", "_n", "_dim").agg(
            F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 1000).alias("_q"), F.min("_v").alias("_low"), F.avg("_v").alias("_mid"))
        step = PARTS // 2
        few = F.when(c("_n") <= 2 * cell_rows, F.array(c("_q")[step - 1])).otherwise(c("_q"))
        cuts = F.filter(F.array_distinct(few), lambda x: x > c("_low"))
        out.append(settle(marks.select(*keys, "_cell", "_dim", F.when(F.size(cuts) > 0, cuts).otherwise(F.array("_mid")).alias("_cuts"))))
    return out


def nearest(train: DataFrame, score: DataFrame, features: Sequence[str], *, k: int, keys: Sequence[str] = (SITE,), carry: Sequence[str] = (),
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest training rows of each scoring row: keys, ts, analog_ts, distance, the carried training columns, rank, cells_visited.

    Ties go to the earlier training hour; (keys, ts) must be unique on either side. Cells hold up to about ``block_rows``
    rows; more rows than that equal in every coordinate are cut into blocks by hash. Scoring rows without any training
    row of their key do not come back.
    """
    keys, features, carry = list(keys), list(features), list(carry)
    cell_rows = max(block_rows, 8 * k)  # so that the smallest usual cell holds k rows
    train = settle(train.select(*keys, TS, *features, *[n for n in carry if n not in features]))
    score = settle(score.select(*keys, TS, *features))
    splits = _splits(train, keys, features, cell_rows)
    kinds = {f.name: f.dataType for f in train.schema.fields}
    schema = T.StructType([*[T.StructField(n, kinds[n]) for n in keys], T.StructField(TS, kinds[TS]), T.StructField("analog_ts", kinds[TS]),
                           T.StructField("distance", T.DoubleType()), *[T.StructField(n, kinds[n]) for n in carry]])
    empty = pd.DataFrame({f.name: pd.Series([], dtype="datetime64[ns]" if f.name in (TS, "analog_ts") else None) for f in schema.fields})
    place, group = [*keys, "_cell"], [*keys, "_cell", "_block", "_slice"]
    # the sizes that a task may meet are bounded on both sides: training blocks and slices of the scoring rows
    held = _cells(train, splits, keys, features)
    boxes = held.groupBy(*keys, "_cell", "_path").agg(F.ceil(F.count(F.lit(1)) / (PARTS * cell_rows)).cast("long").alias("_blocks"),
                                                      *[e for n in features for e in (F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi"))])
    if splits:
        boxes = settle(boxes)

    def best(tp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if len(tp) == 0 or len(qp) == 0:
            return empty.copy()
        tp = tp.sort_values(TS)
        rows, dist = _closest(tp[features].to_numpy(dtype=np.float64), qp[features].to_numpy(dtype=np.float64), k)
        qi, ti, dist = np.repeat(np.arange(len(qp)), rows.shape[1]), rows.ravel(), dist.ravel()
        near = dist <= qp["_bound"].to_numpy()[qi]
        qi, ti, dist = qi[near], ti[near], dist[near]
        out = {n: qp[n].to_numpy()[qi] for n in [*keys, TS]}
        out |= {"analog_ts": tp[TS].to_numpy()[ti], "distance": dist}
        out |= {n: tp[n].to_numpy()[ti] for n in carry}
        return pd.DataFrame(out)

    def meet(visits: DataFrame) -> DataFrame:
        """Best training rows of every (scoring row, cell) pair; ``visits`` has the scoring columns, _bound and _cell."""
        asked = settle(visits.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("long").alias("_slices")).join(
            boxes.select(*place, "_blocks"), place, "inner"))  # read by both sides
        t = held.drop("_path").join(asked, place, "inner").withColumns({"_block": F.pmod(F.xxhash64(TS), c("_blocks")), "_slice": F.explode(F.sequence(F.lit(0).cast("long"), c("_slices") - 1))})
        q = visits.join(asked, place, "inner").withColumns({"_slice": F.pmod(F.xxhash64(TS, F.lit(1)), c("_slices")), "_block": F.explode(F.sequence(F.lit(0).cast("long"), c("_blocks") - 1))})
        t, q = t.select(*group, TS, *features, *[n for n in carry if n not in features]), q.select(*group, TS, *features, "_bound")
        return spread(t, *group).groupBy(*group).cogroup(spread(q, *group).groupBy(*group)).applyInPandas(best, schema)

    w = Window.partitionBy(*keys, TS).orderBy("distance", "analog_ts")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)

    own = _cells(score, splits, keys, features).drop("_path").withColumn("_bound", F.lit(float("inf")))
    if not splits:
        return ranked(meet(own)).withColumn("cells_visited", F.lit(1).cast("long"))
    # first the row's own cell, then the nearest others, then whatever the distance found by then still allows
    found, visited = settle(ranked(meet(own)).drop("rank")), own.select(*keys, TS, F.lit(1).cast("long").alias("_v"))
    near_first, others = Window.partitionBy(*keys, TS).orderBy("_away", "_cell"), None
    for wave in range(2):
        bounds = found.groupBy(*keys, TS).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("_far"))
        rows = (own.drop("_bound") if others is None else others).join(bounds, [*keys, TS], "left").withColumn("_bound", F.coalesce("_far", F.lit(float("inf")))).drop("_far")
        reach = c("_away") <= c("_bound") * (1 + 1e-9) + 1e-9
        if others is None:
            rows = settle(_reachable(rows, boxes, len(splits), keys, features, reach).withColumn("_order", F.row_number().over(near_first)))
            others, visits = rows.filter(c("_order") > FIRST_CELLS).drop("_bound"), rows.filter(c("_order") <= FIRST_CELLS)
        else:
            visits = settle(rows.filter(reach))
        found = settle(ranked(found.unionByName(meet(visits.select(*keys, TS, *features, "_bound", "_cell")))).drop("rank"))
        visited = visited.unionByName(visits.groupBy(*keys, TS).agg(F.count(F.lit(1)).alias("_v")))
    return ranked(found).join(visited.groupBy(*keys, TS).agg(F.sum("_v").alias("cells_visited")), [*keys, TS], "inner")


def _reachable(rows: DataFrame, boxes: DataFrame, levels: int, keys: list[str], features: list[str], reach: Column) -> DataFrame:
    """(scoring row, cell) pairs within reach, the row's own cell left out: down the tree, by the distance to each node's box."""
    edges = [f"{n}_{e}" for n in features for e in ("lo", "hi")]
    out = rows.withColumnRenamed("_cell", "_home").withColumn("_node", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        up, down = F.element_at("_path", level).alias("_node"), F.element_at("_path", level + 1).alias("_child")
        nodes = boxes.groupBy(*keys, up, down).agg(*[(F.min if e.endswith("_lo") else F.max)(e).alias(e) for e in edges])
        gaps = [F.greatest(c(f"{n}_lo") - c(n), c(n) - c(f"{n}_hi"), F.lit(0.0)) for n in features]
        away = gaps[0] * gaps[0]
        for g in gaps[1:]:
            away = away + g * g
        out = out.drop("_away").join(settle(nodes), [*keys, "_node"], "inner").withColumn("_away", F.sqrt(away)).filter(reach)
        out = out.drop("_node", *edges).withColumnRenamed("_child", "_node")
    return out.withColumnRenamed("_node", "_cell").filter(c("_cell") != c("_home")).drop("_home")


def _analog_statistics(history: DataFrame, score: DataFrame, *, k: int, quantile: float, keys: list[str], block_rows: int) -> DataFrame:
    """Statistics of each scoring row's analogs; a row has at most k of them, so its exact percentile is small work."""
    t, q, names = scaled(history, score, weather_features(), keys)
    near = nearest(t, q, names, k=k, keys=keys, carry=["_per_turbine"], block_rows=block_rows)
    weight = 1.0 / (c("distance") + 1e-6)
    return near.groupBy(*keys, TS).agg(
        F.percentile("_per_turbine", F.lit(quantile)).alias("_q"), F.percentile("_per_turbine", F.lit(0.5)).alias("_med"),
        (F.sum(weight * c("_per_turbine")) / F.sum(weight)).alias("_mean"), F.count(F.lit(1)).alias("_n"))


def analog_forecast(train: DataFrame, score: DataFrame, *, target: str, active: str = "active_turbines", k: int = 100, quantile: float = 0.55,
                    keys: Sequence[str] = (SITE,), min_train: int = 1, block_rows: int = BLOCK_ROWS, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Percentile, median and inverse-distance mean of the analogs' per-turbine power, times the active turbines now.

    Every scoring row comes back. Rows whose key has fewer than ``min_train`` training rows search their whole site, as
    ``whole_site`` tells; rows without any analog (no history, a missing feature) have ``n_analogs`` 0 and no forecast.
    """
    keys = list(keys)
    history = train.filter(usable_history(target, cfg=cfg)).withColumns({"_per_turbine": div(target, F.greatest(c(active), F.lit(1)))})
    how = {"k": k, "quantile": quantile, "block_rows": block_rows}
    if keys == [SITE]:
        marked = score.withColumn("whole_site", F.lit(True))
        stats = _analog_statistics(history, score, keys=keys, **how)
    else:
        enough = settle(history.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(c("_k") >= min_train).select(*keys, F.lit(True).alias("_own")))
        marked = score.join(enough, keys, "left").withColumn("whole_site", c("_own").isNull()).drop("_own")
        narrow = _analog_statistics(history.join(enough, keys, "left_semi"), marked.filter(~c("whole_site")), keys=keys, **how)
        wide = _analog_statistics(history, marked.filter("whole_site"), keys=[SITE], **how)
        stats = narrow.drop(*[n for n in keys if n != SITE]).unionByName(wide)
    joined = marked.select(*keys, TS, active, "whole_site").join(stats, [SITE, TS], "left")
    raw = {"analog_quantile_mw": "_q", "analog_median_mw": "_med", "analog_mean_mw": "_mean"}
    joined = joined.withColumns({v: c(v) * c(active) for v in raw.values()})
    return joined.select(*keys, TS, *[clip(v, 0.0, cfg.capacity_mw).alias(n) for n, v in raw.items()], F.coalesce("_n", F.lit(0)).cast("long").alias("n_analogs"), "whole_site")
