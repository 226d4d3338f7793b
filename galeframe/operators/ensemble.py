"""Statistics across weather sources of one row, and redundant-column detection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions.nullsafe import clip, flag, has
from galeframe.functions.physics import power_law, square
from galeframe.functions.rowstats import row_max, row_mean, row_median, row_min, row_range, row_rank, row_std
from galeframe.operators.joins import LAYER_ALPHA, fill_zero
from galeframe.operators.windows import trend_columns
from galeframe.session import prepare

c = F.col


def row_statistics(df: DataFrame, sources: Sequence[str], *, prefix: str) -> DataFrame:
    return df.withColumns({
        f"{prefix}_mean": row_mean(sources), f"{prefix}_median": row_median(sources), f"{prefix}_std": row_std(sources),
        f"{prefix}_min": row_min(sources), f"{prefix}_max": row_max(sources), f"{prefix}_range": row_range(sources),
    })


def consensus_columns(df: DataFrame, *, fill: bool = True, reanalysis: str = "era5_wind_speed_100m") -> DataFrame:
    """Three-source consensus with spread flag, bias of the farm forecast and, with a fourth source, its shift."""
    three = [n for n in (reanalysis, "gfs_ws100m", "ecmwf_ws100m") if n in df.columns]
    if len(three) < 2:
        raise KeyError(f"a consensus needs two of the three sources, found {three}")
    out = df.withColumns({"ens3_ws100_mean": row_mean(three), "ens3_ws100_std": row_std(three),
                          "ens3_ws100_range": row_range(three), "ens3_ws100_min": row_min(three), "ens3_ws100_max": row_max(three)})
    more: dict[str, Column] = {"ens3_spread_flag": flag(c("ens3_ws100_std") > 2.0)}
    if "wind_speed_120m" in df.columns:
        own = power_law("wind_speed_120m", 120.0, 100.0, LAYER_ALPHA)
        more |= {"forecast_vs_ens3": own - c("ens3_ws100_mean"), "forecast_ratio_ens3": own / clip("ens3_ws100_mean", 0.1)}
    if "icon_ws100m" in df.columns:
        four = [*three, "icon_ws100m"]
        more |= {"ens4_ws100_mean": row_mean(four), "ens4_ws100_std": row_std(four),
                 "icon_shift_ens3": row_mean(four) - c("ens3_ws100_mean")}
    out = trend_columns(out.withColumns(more), {"ens3_ws100_std": "ens3_spread"}, rows=(6,))
    if not fill:
        return out
    added = [n for n in out.columns if n not in df.columns and n != "ens3_spread_flag"]
    return fill_zero(out, added)


def turbulence_columns(df: DataFrame) -> DataFrame:
    """Gust over mean wind per source, limited to [1, 5], and its mean, spread and maximum."""
    pairs = {
        "nwp": ("wind_speed_10m", "wind_gusts_10m"), "gfs": ("gfs_ws10m", "gfs_gust10m"), "ecmwf": ("ecmwf_ws10m", "ecmwf_gust10m"),
        "era5": ("era5_wind_speed_10m", "era5_wind_gusts_10m"), "icon": ("icon_ws10m", "icon_gusts10m"),
    }
    used = {t: p for t, p in pairs.items() if has(df, *p)}
    df = df.withColumns({f"_ti_{t}": c(gust) / clip(ws, 0.5) for t, (ws, gust) in used.items()})
    df = df.withColumns({f"{t}_ti_10m": clip(f"_ti_{t}", 1.0, 5.0) for t in used}).drop(*[f"_ti_{t}" for t in used])
    names = [f"{t}_ti_10m" for t in used]
    if len(names) >= 2:
        df = df.withColumns({"ti_multi_mean": row_mean(names), "ti_multi_std": row_std(names), "ti_multi_max": row_max(names)})
        out = {"high_turbulence_flag": flag(c("ti_multi_mean") > 1.8)}
        if "wind_speed_120m" in df.columns:
            ws = c("wind_speed_120m")
            steep = flag((ws >= 7.0) & (ws < 10.0))
            out |= {"ti_x_steep_zone": c("ti_multi_mean") * steep, "ti_spread_x_steep": c("ti_multi_std") * steep}
        df = df.withColumns(out)
    if has(df, "gust_excess_10m", "wind_speed_120m"):
        df = df.withColumns({"gust_excess_x_ws120": c("gust_excess_10m") * c("wind_speed_120m")})
    return df


def rank_columns(df: DataFrame) -> DataFrame:
    """Where the farm forecast sits among all sources at 100 m, and its distance from the median."""
    df = df.withColumns({"_own": power_law("wind_speed_120m", 120.0, 100.0, LAYER_ALPHA)})
    members = ["_own", *[n for n in ("era5_wind_speed_100m", "gfs_ws100m", "ecmwf_ws100m", "icon_ws100m") if n in df.columns]]
    if "nasa_ws50m" in df.columns:
        df = df.withColumns({"_lifted": power_law("nasa_ws50m", 50.0, 100.0, 1.0 / 7.0)})
        members.append("_lifted")
    if len(members) < 3:
        raise KeyError(f"a rank needs two sources beside the farm forecast, found {members[1:]}")
    top = len(members) - 1
    df = df.withColumns({"_rank": row_rank("_own", members, 0), "nwp_vs_ens_median": c("_own") - row_median(members)})
    ws = c("wind_speed_120m")
    steep = flag((ws >= 7.0) & (ws < 10.0))
    share = c("_rank") / float(top)
    return df.withColumns({
        "nwp_rank_in_ens": share, "nwp_rank_centered": share - 0.5,
        "nwp_is_highest_flag": flag(c("_rank") == top), "nwp_is_lowest_flag": flag(c("_rank") == 0),
        "nwp_vs_ens_median_sq": square("nwp_vs_ens_median"),
        "nwp_rank_x_steep": share * steep, "nwp_outlier_x_steep": F.abs("nwp_vs_ens_median") * steep,
    }).drop("_own", "_lifted", "_rank")


def circular_mean_columns(df: DataFrame, directions: Sequence[str], *, prefix: str) -> DataFrame:
    """Mean sine and cosine of several directions in degrees, and the mean direction."""
    df = df.withColumns({f"{prefix}_sin": row_mean([F.sin(F.radians(d)) for d in directions]),
                         f"{prefix}_cos": row_mean([F.cos(F.radians(d)) for d in directions])})
    return df.withColumns({f"{prefix}_deg": F.pmod(F.degrees(F.atan2(f"{prefix}_sin", f"{prefix}_cos")), F.lit(360.0))})


def identical_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs (kept, duplicate) of columns equal in every row.

    A first aggregation groups columns by (sum, min, max, count); only pairs
    inside a group are compared row by row in a second aggregation. What comes
    back to the driver is one row per pass, sized by the number of columns.
    """
    spark = df.sparkSession
    aggs = []
    for n in names:
        aggs += [F.count(n).alias(f"{n}__k"), F.min(n).cast("double").alias(f"{n}__lo"), F.max(n).cast("double").alias(f"{n}__hi")]
    stats = df.agg(*aggs).first().asDict()
    groups: dict[tuple, list[str]] = {}
    for n in names:
        groups.setdefault(tuple(stats[f"{n}__{s}"] for s in ("k", "lo", "hi")), []).append(n)
    pairs = [(g[i], g[j]) for g in groups.values() for i in range(len(g)) for j in range(i + 1, len(g))]
    found: list[tuple[str, str]] = []
    if pairs:
        differ = df.agg(*[F.count_if(~c(a).eqNullSafe(c(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        gone: set[str] = set()
        for i, (a, b) in enumerate(pairs):
            if differ[i] == 0 and a not in gone and b not in gone:
                found.append((a, b))
                gone.add(b)
    return spark.createDataFrame(found, "kept string, duplicate string")


def correlation_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, missing values replaced by the column mean; 0 where one does not vary.

    Two passes, whatever the number of columns: means, then the centred products, which each task sums as one matrix.
    The result has one row per pair. A column without any value counts as constant.
    """
    names = list(names)
    mean_of = df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)]).first()
    centred = df.select(*[F.coalesce(c(n).cast("double") - F.lit(mean_of[i]), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)])
    at = np.triu_indices(len(names))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            x = np.stack([column.to_numpy() for column in batch.columns], 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["i", "j", "s"])

    prepare(df.sparkSession)
    sums = centred.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = sums.filter("i = j").select("i", F.sqrt("s").alias("own"))  # one row per column
    pairs = sums.filter("i < j").join(own.select("i", c("own").alias("_a")), "i").join(own.select(c("i").alias("j"), c("own").alias("_b")), "j")
    name = F.array(*[F.lit(n) for n in names])
    return pairs.select(F.get(name, c("i")).alias("first"), F.get(name, c("j")).alias("second"), F.coalesce(F.try_divide(c("s"), c("_a") * c("_b")), F.lit(0.0)).alias("correlation"))


def kept_columns(df: DataFrame, names: Sequence[str], *, threshold: float = 0.999) -> DataFrame:
    """position, name and whether the greedy choice in column order keeps it: unless it correlates above the threshold
    with a column kept before.

    Only the column-by-column table reaches the driver.
    """
    seen = {(r["first"], r["second"]): r["correlation"] for r in correlation_table(df, names).collect()}
    kept: list[str] = []
    for n in names:
        if all(abs(seen[k, n]) <= threshold for k in kept):
            kept.append(n)
    return df.sparkSession.createDataFrame([(i, n, n in kept) for i, n in enumerate(names)], "position int, name string, kept boolean")


def drop_correlated(df: DataFrame, names: Sequence[str], *, threshold: float = 0.999) -> list[str]:
    return [r["name"] for r in kept_columns(df, names, threshold=threshold).filter("kept").orderBy("position").collect()]
