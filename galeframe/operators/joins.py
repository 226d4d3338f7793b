"""Time-keyed enrichment joins.

Every source is joined on (site, hour), a unique and well-spread key. No side
is forced to broadcast: the planner compares measured sizes at run time and
splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import DEFAULT, PRESSURE, SITE, TS, FarmConfig
from galeframe.functions.nullsafe import clip, has
from galeframe.functions.physics import cube, power_law
from galeframe.functions.rowstats import row_mean, row_median, row_range, row_std

KEY = [SITE, TS]
c = F.col

# Shear exponents used to compare heights.
LAYER_ALPHA = 0.14
SITE_ALPHA = 0.200


class DuplicateKeyError(ValueError):
    pass


class CoverageError(ValueError):
    pass


def require_unique_key(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Fail when a key occurs twice; runs one job that stops at the first duplicate."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise DuplicateKeyError(f"rows are not unique by {list(keys)}")
    return df


def last_by_key(df: DataFrame, *, order: str, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the one with the largest ``order``.

    ``max_by`` aggregates before the shuffle, so a key with very many copies
    costs one row per input partition.
    """
    rest = [n for n in df.columns if n not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[c("_row")[n].alias(n) for n in rest]).select(*df.columns)


def join_source(df: DataFrame, source: DataFrame, *, prefix: str = "", rename: Mapping[str, str] | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Left join of a keyed source, with its columns renamed or prefixed."""
    names = [n for n in source.columns if n not in KEY and (keep is None or n in keep)]
    if rename is not None:
        names = [n for n in names if n in rename]
    renamed = [c(n).alias((rename or {}).get(n, f"{prefix}{n}")) for n in names]
    return df.join(source.select(*KEY, *renamed), KEY, "left")


def fill_zero(df: DataFrame, names: Sequence[str]) -> DataFrame:
    wanted = [n for n in names if n in df.columns]
    return df.withColumns({n: F.coalesce(c(n), F.lit(0.0)) for n in wanted}) if wanted else df


def _new(before: DataFrame, after: DataFrame, *prefixes: str) -> list[str]:
    old = set(before.columns)
    return [n for n in after.columns if n not in old and (not prefixes or n.startswith(prefixes))]


def _angle(prefix: str, deg: str) -> dict[str, Column]:
    return {f"{prefix}_sin": F.sin(F.radians(deg)), f"{prefix}_cos": F.cos(F.radians(deg))}


def join_reanalysis(df: DataFrame, source: DataFrame) -> DataFrame:
    """Reanalysis columns with prefix, biases against the farm forecast; missing hours give 0."""
    out = join_source(df, source, prefix="era5_")
    ws100 = c("era5_wind_speed_100m")
    out = out.withColumns({
        "ws10_bias": c("wind_speed_10m") - c("era5_wind_speed_10m"),
        "ws100_vs_80": ws100 - c("wind_speed_80m"),
        "gust_bias": c("wind_gusts_10m") - c("era5_wind_gusts_10m"),
        "pressure_bias": c(PRESSURE) - c("era5_pressure_msl"),
        "era5_ws100_cube": cube(ws100),
        "era5_ws100_x_active": cube(ws100) * c("active_turbines_ratio"),
        **_angle("era5_dir100", "era5_wind_direction_100m"),
    })
    return fill_zero(out, _new(df, out))


# The columns kept from the second reanalysis group.
SECOND_GROUP = (
    "blh", "cbh", "u850", "v850", "u925", "v925", "wind_speed_850hpa", "wind_speed_925hpa", "llj_strength", "is_llj",
    "cape", "tcwv", "hcc", "mcc", "sshf", "slhf", "cp", "lsp", "stl1", "stl4", "swvl1", "swvl2", "snowc", "sde", "skt",
    "dewpoint_depression", "skt_minus_t2m", "stl1_minus_t2m", "air_density", "alpha_10_100", "wind_speed_84m",
    "wind_speed_120m", "wind_eq_100m", "has_snow", "is_daytime", "u10_land", "v10_land",
)


def join_second_reanalysis(df: DataFrame, source: DataFrame, *, fill: bool = True) -> DataFrame:
    out = join_source(df, source, prefix="era5v2_", keep=SECOND_GROUP)
    return fill_zero(out, _new(df, out)) if fill else out


def multi_source_summary(source: DataFrame) -> DataFrame:
    """Mean, median, deviation and range over the models of one table, and their mean direction."""
    def models(stem: str) -> list[str]:
        return [f"om_{stem}_{m}" for m in ("ecmwf_ifs025", "gfs_global", "icon_global", "best_match")
                if f"om_{stem}_{m}" in source.columns]

    ws100, ws10 = models("wind_speed_100m"), models("wind_speed_10m")
    gust, direction = models("wind_gusts_10m"), models("wind_direction_100m")
    out: dict[str, Column] = {}
    if len(ws100) >= 2:
        out |= {"om_ens_ws100_mean": row_mean(ws100), "om_ens_ws100_median": row_median(ws100),
                "om_ens_ws100_std": row_std(ws100, ddof=1), "om_ens_ws100_range": row_range(ws100),
                "om_ens_ws100_84m": power_law(row_mean(ws100), 100.0, 84.0, LAYER_ALPHA)}
    if len(ws10) >= 2:
        out["om_ens_ws10_mean"] = row_mean(ws10)
    if len(gust) >= 2:
        out["om_ens_gust_mean"] = row_mean(gust)
    if len(direction) >= 2:
        out |= {"om_ens_dir_sin": row_mean([F.sin(F.radians(d)) for d in direction]),
                "om_ens_dir_cos": row_mean([F.cos(F.radians(d)) for d in direction])}
    return source.select(*KEY, *[e.alias(n) for n, e in out.items()])


def join_multi_source(df: DataFrame, source: DataFrame, *, fill: bool = True) -> DataFrame:
    out = df.join(multi_source_summary(source), KEY, "left")
    if has(out, "wind_speed_120m", "om_ens_ws100_mean"):
        out = out.withColumns({
            "om_ens_nwp_diff": power_law("wind_speed_120m", 120.0, 100.0, LAYER_ALPHA) - c("om_ens_ws100_mean")})
    return fill_zero(out, _new(df, out, "om_ens_")) if fill else out


# Column names of the model, and the names they get.
ICON_NAMES = {"wind_speed_100m": "icon_ws100m", "wind_direction_100m": "icon_dir100m", "wind_speed_10m": "icon_ws10m",
              "wind_gusts_10m": "icon_gusts10m", "temperature_2m": "icon_t2m", "pressure_msl": "icon_msl"}


def join_regional_model(df: DataFrame, source: DataFrame, *, impute: bool = False,
                        reanalysis_wind: str = "era5_wind_speed_100m") -> DataFrame:
    """Regional model; optionally fill missing hours with reanalysis wind, exact medians and calm direction."""
    out = join_source(df, source, rename=ICON_NAMES).withColumns(_angle("icon_dir100m", "icon_dir100m"))
    if impute:
        from galeframe.operators.ranks import table_medians

        absent = c("icon_ws100m").isNull()
        fills = {"icon_ws100m": c(reanalysis_wind), "icon_ws10m": c("wind_speed_10m"),
                 "icon_dir100m": F.lit(0.0), "icon_dir100m_sin": F.lit(0.0), "icon_dir100m_cos": F.lit(0.0)}
        fills |= table_medians(out, {n: 0.1 for n in ("icon_gusts10m", "icon_t2m", "icon_msl") if n in out.columns})
        out = out.withColumns({n: F.when(absent, e).otherwise(c(n)) for n, e in fills.items() if n in out.columns})
    spread = row_std([reanalysis_wind, "icon_ws100m"])
    return out.withColumns({
        "icon_delta_ws100m": c("icon_ws100m") - c(reanalysis_wind),
        "icon_ratio_ws100m": c("icon_ws100m") / clip(reanalysis_wind, 0.1),
        "nwp_spread_ws100m": F.coalesce(spread, F.lit(0.0)) if impute else spread,
    })


def join_best_match(df: DataFrame, source: DataFrame, *, reanalysis_wind: str = "era5_wind_speed_100m") -> DataFrame:
    rename = {"om_wind_speed_100m_best_match": "om_bm_ws100", "om_wind_speed_100m_gfs_global": "om_gfs_ws100",
              "om_wind_std": "om_wind_std_v2", "om_wind_range": "om_wind_range_v2", "om_wind_hub_mean": "om_wind_hub_v2"}
    out = join_source(df, source, rename=rename)
    bm, gfs = c("om_bm_ws100"), c("om_gfs_ws100")
    more = {"om_bm_gfs_diff": bm - gfs}
    if reanalysis_wind in df.columns:
        more |= {"om_bm_delta": bm - c(reanalysis_wind), "om_gfs_delta": gfs - c(reanalysis_wind),
                 "om_bm_ratio": bm / clip(reanalysis_wind, 0.1)}
    out = out.withColumns(more)
    return fill_zero(out, _new(df, out))


# Column names of the model, and the names they get.
GFS_NAMES = {"wind_speed_10m": "gfs_ws10m", "wind_speed_100m": "gfs_ws100m", "wind_direction_10m": "gfs_dir10m",
             "wind_direction_100m": "gfs_dir100m", "wind_gusts_10m": "gfs_gust10m", "temperature_2m": "gfs_t2m",
             "pressure_msl": "gfs_msl"}
ECMWF_NAMES = {"wind_speed_10m": "ecmwf_ws10m", "wind_speed_100m": "ecmwf_ws100m", "wind_direction_100m": "ecmwf_dir100m",
               "wind_gusts_10m": "ecmwf_gust10m", "temperature_2m": "ecmwf_t2m", "pressure_msl": "ecmwf_msl"}


def _global_model(df: DataFrame, source: DataFrame, tag: str, names: Mapping[str, str], *, trends: bool) -> DataFrame:
    from galeframe.operators.windows import trend_columns

    out = join_source(df, source, rename=names)
    ws = c(f"{tag}_ws100m")
    more = {**_angle(f"{tag}_dir100m", f"{tag}_dir100m"), f"{tag}_ws100m_cube": cube(ws)}
    if "era5_wind_speed_100m" in df.columns:
        more |= {f"{tag}_vs_era5_100": ws - c("era5_wind_speed_100m"),
                 f"{tag}_ratio_era5_100": ws / clip("era5_wind_speed_100m", 0.1)}
    if "wind_speed_120m" in df.columns:
        more[f"{tag}_vs_nwp_100"] = ws - power_law("wind_speed_120m", 120.0, 100.0, LAYER_ALPHA)
    out = out.withColumns(more)
    return trend_columns(out, {f"{tag}_ws100m": f"{tag}_ws100m"}) if trends else out


def join_global_model_a(df: DataFrame, source: DataFrame, *, fill: bool = True, trends: bool = True) -> DataFrame:
    out = _global_model(df, source, "gfs", GFS_NAMES, trends=trends)
    return fill_zero(out, _new(df, out)) if fill else out


def join_global_model_b(df: DataFrame, source: DataFrame, *, fill: bool = True, trends: bool = True) -> DataFrame:
    """Second global model, and its difference and mean with the first when that is present."""
    out = _global_model(df, source, "ecmwf", ECMWF_NAMES, trends=trends)
    if "gfs_ws100m" in df.columns:
        out = out.withColumns({"gfs_vs_ecmwf_100": c("gfs_ws100m") - c("ecmwf_ws100m"),
                               "ecmwf_gfs_mean": (c("gfs_ws100m") + c("ecmwf_ws100m")) / 2.0})
    return fill_zero(out, _new(df, out)) if fill else out


def join_independent_reanalysis(df: DataFrame, source: DataFrame, *, fill: bool = True) -> DataFrame:
    """Second reanalysis family: directions, shear, roughness products and spread against the first."""
    out = join_source(df, source, prefix="nasa_")
    ws50, more = c("nasa_ws50m"), {}
    for h in ("10m", "50m"):
        if f"nasa_wd{h}" in out.columns:
            more |= _angle(f"nasa_wd{h}", f"nasa_wd{h}")
    more["nasa_ws50m_cube"] = cube(ws50)
    for other, name in (("nasa_z0m", "nasa_roughness_x_ws50"), ("nasa_disph", "nasa_disph_x_ws50")):
        if other in out.columns:
            more[name] = c(other) * ws50
    if "nasa_ws10m" in out.columns:
        more["nasa_shear_10_50"] = ws50 - c("nasa_ws10m")
    if "era5_wind_speed_100m" in df.columns:
        more |= {"nasa_ws50_vs_era5_100": ws50 - c("era5_wind_speed_100m"),
                 "nwp_spread_nasa_era5": row_std(["era5_wind_speed_100m", "nasa_ws50m"])}
    if has(out, "era5_wind_speed_10m", "nasa_ws10m"):
        more["nasa_ws10_vs_era5_10"] = c("nasa_ws10m") - c("era5_wind_speed_10m")
    if has(out, "era5_temperature_2m", "nasa_t2m"):
        more["nasa_t2m_vs_era5"] = c("nasa_t2m") - c("era5_temperature_2m")
    out = out.withColumns(more).withColumnsRenamed(
        {"nasa_prectotcorr": "nasa_prectot", "nasa_allsky_sfc_sw_dwn": "nasa_allsky_sw"})
    return fill_zero(out, _new(df, out)) if fill else out


def join_surface_models(df: DataFrame, first: DataFrame, second: DataFrame, *, ref_10m: str = "wind_speed_10m",
                        ref_100m: str = "wind_speed_100m", ref_gust: str = "wind_gusts_10m") -> DataFrame:
    """Two surface models lifted from 10 to 100 m, their biases against a reference and the spread of all sources."""
    out = join_source(df, first, rename={"wind_speed_10m": "gem_ws10m", "wind_gusts_10m": "_gem_gust"})
    out = join_source(out, second, rename={"wind_speed_10m": "icong_ws10m"})
    more: dict[str, Column] = {}
    for tag in ("gem", "icong"):
        lifted = power_law(f"{tag}_ws10m", 10.0, 100.0, SITE_ALPHA)
        more[f"{tag}_ws100_extrap"] = lifted
        if ref_10m in df.columns:
            more[f"{tag}_ws10_vs_era5"] = c(f"{tag}_ws10m") - c(ref_10m)
        if ref_100m in df.columns:
            more[f"{tag}_vs_era5_100m_bias"] = lifted - c(ref_100m)
    more["gem_ws100_extrap_cube"] = cube(power_law("gem_ws10m", 10.0, 100.0, SITE_ALPHA))
    if ref_gust in df.columns and "_gem_gust" in out.columns:
        more["gem_gust_vs_era5"] = c("_gem_gust") - c(ref_gust)
    out = out.withColumns(more).drop("_gem_gust")
    low = [n for n in (ref_10m, "gfs_ws10m", "gem_ws10m", "icong_ws10m") if n in out.columns]
    high = [n for n in (ref_100m, "gfs_ws100m", "gem_ws100_extrap", "icong_ws100_extrap") if n in out.columns]
    return out.withColumns({"surface_model_spread_10m": row_std(low), "surface_model_spread_100m": row_std(high)})


def join_ai_forecast(df: DataFrame, source: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """Machine-learned forecasts. ``keep`` names the source's columns, so the result does not depend on how full they are."""
    if absent := [n for n in keep if n not in source.columns]:
        raise KeyError(f"source has no columns {absent}")
    out = join_source(df, source, keep=list(keep))
    more: dict[str, Column] = {}
    if "graphcast_wind_speed_10m" in out.columns:
        more["gc_ws10_bias"] = c("wind_speed_10m") - c("graphcast_wind_speed_10m")
    if "graphcast_pressure_msl" in out.columns:
        more["gc_pressure_bias"] = c(PRESSURE) - c("graphcast_pressure_msl")
    if "aifs_wind_speed_100m" in out.columns:
        ws = c("aifs_wind_speed_100m")
        more |= {"aifs_ws100_vs_80": ws - c("wind_speed_80m"), "aifs_ws100_cube": cube(ws)}
        if "era5_wind_speed_100m" in df.columns:
            more["era5_aifs_ws_diff"] = c("era5_wind_speed_100m") - ws
    if "aifs_wind_direction_100m" in out.columns:
        rad = F.radians(F.coalesce(c("aifs_wind_direction_100m"), F.lit(0.0)))
        more |= {"aifs_dir100_sin": F.sin(rad), "aifs_dir100_cos": F.cos(rad)}
    return out.withColumns(more) if more else out


def coverage(df: DataFrame, source: DataFrame, *, keys: Sequence[str] = KEY) -> DataFrame:
    """One row: rows, matched rows and matched share."""
    marked = df.select(*keys).join(source.select(*keys).withColumn("_m", F.lit(1)), list(keys), "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_m").alias("n_matched")).withColumn(
        "matched_share", F.try_divide(c("n_matched").cast("double"), c("n_rows").cast("double")))


def join_with_coverage(df: DataFrame, source: DataFrame, *, keys: Sequence[str] = KEY, at_least: float = 0.5) -> DataFrame:
    """Left join that fails when less than ``at_least`` of the rows find a partner."""
    share = coverage(df, source, keys=keys).first()["matched_share"]
    if share is not None and share < at_least:
        raise CoverageError(f"only {share:.1%} of the rows have a partner (< {at_least:.0%})")
    return df.join(source, list(keys), "left")


def align_predictions(tables: Mapping[str, DataFrame], *, keys: Sequence[str] = ("fold", SITE, TS),
                      shared: Sequence[str] = ("target_mw",)) -> DataFrame:
    """Inner join of several prediction tables; each keeps its columns under its own tag."""
    out = None
    for tag, t in tables.items():
        own = [n for n in t.columns if n not in (*keys, *shared)]
        part = t.select(*keys, *(shared if out is None else ()), *[c(n).alias(f"{tag}_{n}") for n in own])
        out = part if out is None else out.join(part, list(keys), "inner")
    return out


def outer_merge(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All hours of all sources side by side; each source's columns get its prefix."""
    out = None
    for tag, t in tables.items():
        part = t.select(*KEY, *[c(n).alias(f"{tag}_{n}") for n in t.columns if n not in KEY])
        out = part if out is None else out.join(part, KEY, "full_outer")
    return out


def stitch_forecast(base: DataFrame, other: DataFrame, *, start, hours: int, alpha: float = 1.0, base_col: str = "pred_mw",
                    other_col: str = "other_mw", out: str = "stitched_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Replace (alpha = 1) or blend the first ``hours`` from ``start`` with another forecast."""
    lo = F.lit(start).cast("timestamp_ntz")
    inside = (c(TS) >= lo) & (c(TS) < lo + F.make_dt_interval(hours=F.lit(hours)))
    joined = base.join(other.select(*KEY, c(other_col).alias("_other")).filter(inside), KEY, "left")
    mixed = F.when(c("_other").isNotNull(), alpha * c("_other") + (1.0 - alpha) * c(base_col)).otherwise(c(base_col))
    return joined.withColumns({"_mix": mixed}).withColumns({out: clip("_mix", 0.0, cfg.capacity_mw)}).drop("_other", "_mix")


def fill_reanalysis_from_forecast(df: DataFrame) -> DataFrame:
    """Missing reanalysis values from the farm forecast, with the unit changes; biases become 0 there."""
    fallback = {
        "era5_wind_speed_10m": c("wind_speed_10m"), "era5_wind_speed_100m": c("wind_speed_80m"),
        "era5_wind_direction_10m": c("wind_direction_10m") * 1000.0, "era5_wind_direction_100m": c("wind_direction_80m") * 1000.0,
        "era5_wind_gusts_10m": c("wind_gusts_10m"), "era5_temperature_2m": c("temperature_80m"), "era5_pressure_msl": c(PRESSURE),
        "era5_cloud_cover_low": c("cloud_cover_low") * 100.0, "era5_rain": c("rain"), "era5_snowfall": c("snowfall"),
        "ws10_bias": F.lit(0.0), "ws100_vs_80": F.lit(0.0), "gust_bias": F.lit(0.0), "pressure_bias": F.lit(0.0),
    }
    out = df.withColumns({n: F.coalesce(c(n), e) if n in df.columns else e for n, e in fallback.items()})
    return out.withColumns({
        "era5_ws100_cube": cube("era5_wind_speed_100m"),
        "era5_ws100_x_active": cube("era5_wind_speed_100m") * c("active_turbines_ratio"),
        **_angle("era5_dir100", "era5_wind_direction_100m"),
    })


def assign_folds(df: DataFrame, folds: Sequence[tuple[str, str, str, str]], *, ts: str = TS, embargo_hours: int = 0) -> DataFrame:
    """One row per (row, fold) with role train or val.

    ``folds`` holds (name, train_end, val_start, val_end), all inclusive. The
    list is short and fixed, so each row carries it as a constant array and no
    join is needed. ``embargo_hours`` ends training that long before validation.
    """
    def at(text: str) -> Column:
        return F.lit(text).cast("timestamp_ntz")

    t = c(ts)
    roles = []
    for name, train_end, val_start, val_end in folds:
        if train_end >= val_start:
            raise ValueError(f"fold {name}: training reaches into validation")
        last = F.least(at(train_end), at(val_start) - F.make_dt_interval(hours=F.lit(embargo_hours)))
        role = F.when(t <= last, F.lit("train")).when((t >= at(val_start)) & (t <= at(val_end)), F.lit("val"))
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(name).alias("fold_name"), role.alias("role"))))
    exploded = df.withColumn("_fold", F.explode(F.array_compact(F.array(*roles))))
    return exploded.withColumns({"fold_name": c("_fold.fold_name"), "role": c("_fold.role")}).drop("_fold")


# The default walk-forward folds.
DEFAULT_FOLDS = (
    ("fold1_2023Q1", "2022-12-31 23:00:00", "2023-01-01 00:00:00", "2023-03-31 23:00:00"),
    ("fold2_2023Q4", "2023-09-30 23:00:00", "2023-10-01 00:00:00", "2023-12-31 23:00:00"),
    ("fold3_2024Q2", "2024-03-31 23:00:00", "2024-04-01 00:00:00", "2024-06-30 23:00:00"),
    ("fold4_2024Q4", "2024-09-30 23:00:00", "2024-10-01 00:00:00", "2024-12-31 23:00:00"),
    ("fold5_2025Q1", "2024-12-31 23:00:00", "2025-01-01 00:00:00", "2025-03-31 23:00:00"),
)

