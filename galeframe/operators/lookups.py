"""Tables fitted on a training subset and applied to any rows.

A fit returns a small table keyed by site (and sector, bin ...); applying it is
an equi-join left to the planner, which compares measured sizes at run time.
Fits take a row condition, so nothing after a training end leaks in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import DEFAULT, SITE, TARGET, TS, FarmConfig
from galeframe.functions.nullsafe import (
    correlation,
    bin_even, bin_left_closed, bin_right_closed, clip, div, has, sector_clamped, sector_wrapped,
)
from galeframe.operators.isotonic import Segments, apply_isotonic, fit_isotonic, segments
from galeframe.operators.ranks import percentiles
from galeframe.operators.settle import settle
from galeframe.operators.windows import trailing_days_mean, walk_forward_rate

c = F.col


def valid_target(target: str = TARGET) -> Column:
    return c(target).isNotNull() & (c(target) >= 0)


def _keep(df: DataFrame, fit_filter: Column | None) -> DataFrame:
    return df if fit_filter is None else df.filter(fit_filter)


def stacked_levels(rows: DataFrame, value: str, levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each row once per level, with the keys a level does not use set to NULL, so one pass fits all levels."""
    keys = [n for n in rows.columns if n not in (SITE, value)]
    item = F.array(*[F.struct(F.lit(name).alias("_level"), *[(c(k) if k in used else F.lit(None).cast("int")).alias(k) for k in keys])
                     for name, used in levels.items()])
    return rows.select(SITE, value, F.inline(item))


# --- binned power curve -------------------------------------------------------------------------

def fit_power_curve(df: DataFrame, *, wind: str = "wind_speed_80m", direction: str = "wind_direction_80m", n_sectors: int = 8,
                    width: float = 0.5, wind_max: float = 25.0, fit_filter: Column | None = None) -> dict[str, DataFrame]:
    """Median power by (wind bin, sector) with more than 3 rows and by wind bin with more than 5."""
    last = int(round(wind_max / width)) - 1
    rows = _keep(df, fit_filter).filter(valid_target() & c(wind).isNotNull() & c(direction).isNotNull()).select(
        SITE, TARGET, bin_even(wind, width, 0, last).alias("ws_bin"),
        sector_wrapped(c(direction) * 1000.0, n_sectors).alias("sector"))
    levels = stacked_levels(rows, TARGET, {"cell": ("ws_bin", "sector"), "bin": ("ws_bin",)})
    found = settle(percentiles(levels, [SITE, "_level", "ws_bin", "sector"], TARGET, {"_mw": 0.5}, width=0.5, count="_n"))
    return {"cells": found.filter((c("_level") == "cell") & (c("_n") > 3)).select(SITE, "ws_bin", "sector", c("_mw").alias("cell_mw")),
            "bins": found.filter((c("_level") == "bin") & (c("_n") > 5)).select(SITE, "ws_bin", c("_mw").alias("bin_mw"))}


def apply_power_curve(df: DataFrame, fit: dict[str, DataFrame], *, wind: str = "wind_speed_80m", direction: str = "wind_direction_80m",
                      n_sectors: int = 8, width: float = 0.5, wind_max: float = 25.0, out: str = "p_curve_binned",
                      cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Cell value, else bin value, else 0."""
    last = int(round(wind_max / width)) - 1
    tagged = df.withColumns({"ws_bin": bin_even(wind, width, 0, last), "sector": sector_clamped(c(direction) * 1000.0, n_sectors)})
    joined = tagged.join(fit["cells"], [SITE, "ws_bin", "sector"], "left").join(fit["bins"], [SITE, "ws_bin"], "left")
    value = F.coalesce(c("cell_mw"), c("bin_mw"), F.lit(0.0))
    return joined.withColumns({out: clip(value, 0.0, cfg.capacity_mw)}).drop("ws_bin", "sector", "cell_mw", "bin_mw")


# --- wake ---------------------------------------------------------------------------------------

# Wind bin edges of the wake table.
WAKE_EDGES = (0, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 25)


def fit_wake(df: DataFrame, *, theory: str, n_sectors: int = 16, edges: Sequence[float] = WAKE_EDGES,
             fit_filter: Column | None = None) -> dict[str, DataFrame]:
    """Median of actual over theoretical power by (sector, bin), by sector and by site."""
    rows = _keep(df, fit_filter).filter((c(TARGET) > 0.5) & (c(theory) > 1.0)).select(
        SITE, div(TARGET, theory).alias("_ratio"), sector_wrapped(c("wind_direction_80m") * 1000.0, n_sectors).alias("wake_sector"),
        bin_left_closed("wind_speed_80m", edges, clamp=True).alias("wake_bin")).filter((c("_ratio") > 0.3) & (c("_ratio") < 1.3))
    levels = stacked_levels(rows, "_ratio", {"cell": ("wake_sector", "wake_bin"), "sector": ("wake_sector",), "site": ()})
    found = settle(percentiles(levels, [SITE, "_level", "wake_sector", "wake_bin"], "_ratio", {"_factor": 0.5}, width=0.01, count="_n"))

    def level(name: str, least: int, keys: Sequence[str]) -> DataFrame:
        rows_of = found.filter((c("_level") == name) & (c("_n") >= least))
        return rows_of.select(SITE, *keys, c("_factor").alias(f"{name}_factor"))
    return {"cells": level("cell", 10, ["wake_sector", "wake_bin"]), "sectors": level("sector", 50, ["wake_sector"]), "sites": level("site", 1, [])}


def apply_wake_factor(df: DataFrame, fit: dict[str, DataFrame], *, wind: str, degrees: Column, out: str, n_sectors: int = 16,
                      edges: Sequence[float] = WAKE_EDGES) -> DataFrame:
    """Cell factor, else sector, else site, else 1; limited to [0.3, 1.3]."""
    tagged = df.withColumns({"wake_sector": sector_wrapped(degrees, n_sectors), "wake_bin": bin_left_closed(wind, edges, clamp=True)})
    joined = (tagged.join(fit["cells"], [SITE, "wake_sector", "wake_bin"], "left")
              .join(fit["sectors"], [SITE, "wake_sector"], "left").join(fit["sites"], [SITE], "left"))
    value = F.coalesce(c("cell_factor"), c("sector_factor"), c("site_factor"), F.lit(1.0))
    return joined.withColumns({out: clip(value, 0.3, 1.3)}).drop("wake_sector", "wake_bin", "cell_factor", "sector_factor", "site_factor")


def wake_columns(df: DataFrame, fit: dict[str, DataFrame], cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Theoretical power times wake factor, for the farm forecast and, when present, the reanalysis."""
    out = apply_wake_factor(df, fit, wind="wind_speed_80m", degrees=c("wind_direction_80m") * 1000.0, out="wake_factor")
    more = {}
    if "ds_80m_farm_mw" in df.columns:
        corrected = c("ds_80m_farm_mw") * c("wake_factor")
        more |= {"ds_wake_corrected": corrected, "ds_wake_corrected_ratio": corrected / cfg.capacity_mw}
    if "ds_consensus_farm_mw" in df.columns:
        more["ds_consensus_wake_corrected"] = c("ds_consensus_farm_mw") * c("wake_factor")
    out = out.withColumns(more)
    if has(df, "era5_wind_speed_100m", "era5_wind_direction_100m", "ds_era5_100m_farm_mw"):
        out = apply_wake_factor(out, fit, wind="era5_wind_speed_100m", degrees=c("era5_wind_direction_100m"), out="era5_wake_factor")
        out = out.withColumns({"ds_era5_wake_corrected": c("ds_era5_100m_farm_mw") * c("era5_wake_factor")})
    return out


# --- isotonic power curves ----------------------------------------------------------------------

def fit_site_curve(df: DataFrame, *, wind: str = "v_eff", target: str = TARGET, fit_filter: Column | None = None) -> DataFrame:
    cond = valid_target(target) if fit_filter is None else valid_target(target) & fit_filter
    return settle(fit_isotonic(df, [SITE], wind, target, fit_filter=cond))


def site_segments(curve: DataFrame | Segments) -> Segments:
    """A site curve ready for several look-ups."""
    return curve if isinstance(curve, Segments) else segments(curve, [SITE])


def apply_site_curve(df: DataFrame, curve: DataFrame | Segments, *, wind: str, out: str) -> DataFrame:
    return apply_isotonic(df, site_segments(curve), [SITE], {out: wind})


def fit_sector_curve(df: DataFrame, *, wind: str = "v_eff", degrees: Column | None = None, n_sectors: int = 8, min_rows: int = 51,
                     fit_filter: Column | None = None) -> DataFrame:
    """One curve per (site, sector) that has at least ``min_rows`` rows."""
    deg = c("wind_direction_120m") * 1000.0 if degrees is None else degrees
    cond = valid_target() if fit_filter is None else valid_target() & fit_filter
    tagged = df.withColumn("curve_sector", sector_wrapped(deg, n_sectors)).filter(c("curve_sector").isNotNull())
    return settle(fit_isotonic(tagged, [SITE, "curve_sector"], wind, TARGET, fit_filter=cond, min_rows=min_rows))


def apply_sector_curve(df: DataFrame, sector_curve: DataFrame, site_curve: DataFrame | Segments, *, wind: str, out: str,
                       degrees: Column | None = None, n_sectors: int = 8, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Sector curve where there is one, else the site curve."""
    deg = c("wind_direction_120m") * 1000.0 if degrees is None else degrees
    keys = [SITE, "curve_sector"]
    tagged = df.withColumn("curve_sector", sector_wrapped(deg, n_sectors))
    both = apply_isotonic(tagged, segments(sector_curve, keys), keys, {"_by_sector": wind})
    both = apply_site_curve(both, site_curve, wind=wind, out="_by_site")
    return both.withColumns({out: clip(F.coalesce(c("_by_sector"), c("_by_site")), 0.0, cfg.capacity_mw)}).drop(
        "curve_sector", "_by_sector", "_by_site")


WHOLE_SITE = -1  # the sector that stands for all of a site


def fit_curves(df: DataFrame, *, wind: str = "v_eff", degrees: Column | None = None, n_sectors: int = 8, min_rows: int = 51,
               fit_filter: Column | None = None) -> DataFrame:
    """Site curves and sector curves of one fit: keys site and ``curve_sector``, ``WHOLE_SITE`` for the site's own curve."""
    deg = c("wind_direction_120m") * 1000.0 if degrees is None else degrees
    cond = valid_target() if fit_filter is None else valid_target() & fit_filter
    both = F.array_compact(F.array(F.lit(WHOLE_SITE), sector_wrapped(deg, n_sectors)))
    rows = df.filter(cond).select(SITE, wind, TARGET, F.explode(both).alias("curve_sector"))
    least = F.when(c("curve_sector") == WHOLE_SITE, 1).otherwise(min_rows)
    return settle(fit_isotonic(rows, [SITE, "curve_sector"], wind, TARGET, min_rows=least))


def curve_columns(df: DataFrame, curves: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Sector, site and rotor-wind curve power and their products with availability; ``curves`` come from ``fit_curves``."""
    keys, tree = [SITE, "curve_sector"], segments(curves, [SITE, "curve_sector"])
    out = apply_isotonic(df.withColumn("curve_sector", F.lit(WHOLE_SITE)), tree, keys, {"p_curve_global": "v_eff", "p_curve_rews": "rews"})
    out = out.withColumn("curve_sector", sector_wrapped(c("wind_direction_120m") * 1000.0, 8))
    out = apply_isotonic(out, tree, keys, {"_by_sector": "v_eff"}).drop("curve_sector")
    by_sector = clip(F.coalesce(c("_by_sector"), c("p_curve_global")), 0.0, cfg.capacity_mw)
    out = out.withColumn("p_curve_sector", by_sector).drop("_by_sector")
    return out.withColumns({
        "p_curve_x_active": c("p_curve_sector") * c("active_turbines_ratio"),
        "p_curve_global_x_active": c("p_curve_global") * c("active_turbines_ratio"),
        "p_curve_ratio": c("p_curve_sector") / cfg.capacity_mw,
        "p_curve_sector_minus_global": c("p_curve_sector") - c("p_curve_global"),
    })


def impute_upper_level(df: DataFrame, *, fallback_alpha: float = 0.143) -> DataFrame:
    """Fill 180 m wind from 120 m with the site's mean shear exponent, and its direction from 120 m."""
    ws120, ws180 = c("wind_speed_120m"), c("wind_speed_180m")
    usable = ws180.isNotNull() & (ws120 > 0.1) & (ws180 > 0.1)
    alpha = df.groupBy(SITE).agg(
        (F.avg(F.when(usable, F.ln(ws180 / ws120))) / F.ln(F.lit(1.5))).alias("_alpha"))
    joined = df.join(settle(alpha), SITE, "left")
    lifted = ws120 * F.pow(F.lit(1.5), F.coalesce(c("_alpha"), F.lit(fallback_alpha)))
    return joined.withColumns({
        "ws_180m_is_imputed": (ws180.isNull() & lifted.isNotNull()).cast("int"),
        "wind_speed_180m": F.coalesce(ws180, lifted),
        "wind_direction_180m": F.coalesce(c("wind_direction_180m"), c("wind_direction_120m")),
    }).drop("_alpha")


def walk_forward_availability(df: DataFrame, *, train_end, freeze_after=None, wind: str = "wind_speed_120m",
                              impossible: str | None = "_is_impossible", days: int = 30) -> DataFrame:
    """Expected power from a curve fitted up to ``train_end``, the under-production against it, and its
    strictly past averages by (month, hour) and over the last ``days`` days.

    Under-production is unknown after ``train_end`` (and ``freeze_after``), so later targets cannot leak.
    """
    t = c(TS)
    end = F.lit(train_end).cast("timestamp_ntz")
    usable = t <= end
    if impossible and impossible in df.columns:
        usable = usable & ~F.coalesce(c(impossible).cast("boolean"), F.lit(False))
    curve = fit_site_curve(df, wind=wind, fit_filter=usable)
    out = apply_site_curve(df, curve, wind=wind, out="avail_p_expected_mw")
    seen = usable if freeze_after is None else usable & (t <= F.lit(freeze_after).cast("timestamp_ntz"))
    out = out.withColumns({
        "avail_underprod_mw": F.when(seen & c(TARGET).isNotNull(), c(TARGET) - c("avail_p_expected_mw"))})
    out = walk_forward_rate(out, value="avail_underprod_mw")
    return trailing_days_mean(out, value="avail_underprod_mw", out=f"avail_underprod_rate_{days}d", days=days)


# --- descriptive tables -------------------------------------------------------------------------

def conditional_power(df: DataFrame, *, months: Sequence[int], hours: tuple[int, int], wind: str = "wind_speed_120m",
                      width: float = 0.5, n_bins: int = 17) -> DataFrame:
    """Count, mean, median, deviation and quartiles of power by right-closed wind bin for chosen months and hours."""
    edges = [i * width for i in range(n_bins + 1)]
    rows = df.filter(F.month(TS).isin(*months) & F.hour(TS).between(*hours)).select(
        SITE, TARGET, bin_right_closed(wind, edges).alias("ws_bin")).filter(c("ws_bin").isNotNull() & c(TARGET).isNotNull())
    keys = [SITE, "ws_bin"]
    sums = rows.groupBy(*keys).agg(F.count(TARGET).alias("n"), F.avg(TARGET).alias("mean"), F.stddev_samp(TARGET).alias("std"))
    pct = percentiles(rows, keys, TARGET, {"median": 0.5, "p25": 0.25, "p75": 0.75}, width=0.5)
    return sums.join(pct, keys, "inner")


def fit_envelope(df: DataFrame, *, wind: str, target: str, edges: Sequence[float], fit_filter: Column | None = None) -> DataFrame:
    """5th and 95th percentile of the target by wind bin."""
    rows = _keep(df, fit_filter).withColumn("env_bin", bin_left_closed(wind, edges, clamp=False)).filter(c("env_bin").isNotNull())
    return settle(percentiles(rows, [SITE, "env_bin"], target, {"env_lo": 0.05, "env_hi": 0.95}, width=0.5))


def apply_envelope(df: DataFrame, envelope: DataFrame, *, wind: str, pred: str, edges: Sequence[float], out: str = "pred_capped",
                   cfg: FarmConfig = DEFAULT) -> DataFrame:
    tagged = df.withColumn("env_bin", bin_left_closed(wind, edges, clamp=False))
    joined = tagged.join(envelope, [SITE, "env_bin"], "left")
    hi, lo = F.coalesce(c("env_hi"), F.lit(cfg.capacity_mw)), F.coalesce(c("env_lo"), F.lit(0.0))
    inside = F.greatest(lo, F.least(hi, c(pred)))
    limited = F.when(c(pred).isNull(), c(pred)).when(c("env_bin").isNull(), c(pred)).otherwise(inside)
    return joined.withColumns({out: clip(limited, 0.0, cfg.capacity_mw)}).drop("env_bin", "env_lo", "env_hi")


# Bins of the wake-loss and gust reports.
WAKE_LOSS_EDGES = (0, 4, 6, 8, 10, 12, 14, 25)
GUST_EDGES = (0, 5, 10, 15, 18, 20, 22, 25, 30)


def wake_loss_table(df: DataFrame, *, theory: str = "ds_80m_farm_mw") -> DataFrame:
    """Mean theory-minus-actual by sector, one column per wind bin, with counts and the loss share above 6 m/s."""
    loss = c(theory) - c(TARGET)
    rows = df.withColumns({
        "_loss": loss, "sector": sector_wrapped(c("wind_direction_80m") * 1000.0, 16),
        "_bin": bin_right_closed("wind_speed_80m", WAKE_LOSS_EDGES), "_frac": div(loss, theory),
    }).filter((F.abs("_loss") < 30) & (c(TARGET) > 0.5) & (c(theory) > 0.5))
    aggs = [F.avg(F.when(c("_bin") == b, c("_loss"))).alias(f"loss_bin{b}") for b in range(len(WAKE_LOSS_EDGES) - 1)]
    aggs += [F.count_if(c("_bin") == b).alias(f"n_bin{b}") for b in range(len(WAKE_LOSS_EDGES) - 1)]
    return rows.groupBy(SITE, "sector").agg(
        *aggs, F.count(F.lit(1)).alias("n"), F.avg("_loss").alias("mean_loss"), F.stddev_samp("_loss").alias("std_loss"),
        F.avg(F.when(c("wind_speed_80m") >= 6, c("_frac"))).alias("loss_share"))


def compare_periods(df: DataFrame, period: Column, columns: Sequence[str], *, width: float = 0.1) -> DataFrame:
    """Count, mean, deviation and median of each column per period, one row per (period, column)."""
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in columns)
    long = df.withColumn("period", period).filter(c("period").isNotNull()).select(
        "period", F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, value)"))
    keys = ["period", "column_name"]
    sums = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return sums.join(percentiles(long, keys, "value", {"median": 0.5}, width=width), keys, "inner")


def source_agreement(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation, mean difference, mean and largest absolute difference for pairs of sources, from one aggregation."""
    aggs, rows = [], []
    for i, (a, b) in enumerate(pairs):
        both = c(a).isNotNull() & c(b).isNotNull()
        gap = F.when(both, c(a) - c(b))
        aggs += [F.count_if(both).alias(f"n{i}"), correlation(a, b).alias(f"r{i}"), F.avg(gap).alias(f"d{i}"),
                 F.avg(F.abs(gap)).alias(f"m{i}"), F.max(F.abs(gap)).alias(f"x{i}")]
        rows.append(f"'{a}', '{b}', n{i}, r{i}, d{i}, m{i}, x{i}")
    return df.agg(*aggs).select(F.expr(
        f"stack({len(pairs)}, {', '.join(rows)}) AS (first, second, n, correlation, mean_diff, mean_abs_diff, max_abs_diff)"))


def value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest and mean value and present and missing counts per column and year."""
    aggs, rows = [], []
    for i, n in enumerate(columns):
        aggs += [F.min(n).cast("double").alias(f"a{i}"), F.max(n).cast("double").alias(f"b{i}"), F.avg(n).alias(f"c{i}"),
                 F.count(n).alias(f"d{i}"), F.count_if(c(n).isNull()).alias(f"e{i}")]
        rows.append(f"'{n}', a{i}, b{i}, c{i}, d{i}, e{i}")
    wide = df.groupBy(F.year(TS).alias("year")).agg(*aggs)
    return wide.select("year", F.expr(
        f"stack({len(columns)}, {', '.join(rows)}) AS (column_name, min_value, max_value, mean_value, n_present, n_missing)"))


def rate_table(df: DataFrame, flag_col: str, by: dict[str, Column]) -> DataFrame:
    """Share of flagged rows for each value of each grouping; one pass over the table."""
    items = F.array(*[F.struct(F.lit(k).alias("grouping"), e.cast("long").alias("value")) for k, e in by.items()])
    long = df.select(c(flag_col).cast("int").alias("_f"), F.explode(items).alias("_g"))
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_f") * 100.0).alias("flagged_pct"))


def gust_table(df: DataFrame, *, low_mw: float = 2.0) -> DataFrame:
    """Power by right-closed gust bin with the share of rows under ``low_mw``."""
    rows = df.withColumn("gust_bin", bin_right_closed("wind_gusts_10m", GUST_EDGES)).filter(c("gust_bin").isNotNull())
    sums = rows.groupBy("gust_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("mean_power"), F.avg("wind_speed_80m").alias("mean_ws80"),
        F.avg((c(TARGET) < low_mw).cast("int")).alias("low_power_rate"))
    return sums.join(percentiles(rows, ["gust_bin"], TARGET, {"median_power": 0.5}, width=0.01), "gust_bin", "inner")


