"""Row-wise physics and calendar columns from the farm's own forecast feed.

Every operator is one or two projections of built-in expressions: no shuffle,
no Python workers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import (
    CLOUD, DEFAULT, GUST, KELVIN, PRECIP_COLS, PRESSURE, R_DRY_PRECISE, REPAIR, RHO_STD, TARGET, TS, WD_COLS, WS_COLS,
    FarmConfig,
)
from galeframe.functions.curve import farm_power_mw, turbine_power_kw
from galeframe.functions.nullsafe import (
    clip, div, evaluate_once, flag, has, sector_clamped, zero_if_null,
)
from galeframe.functions.physics import (
    air_density, cube, density_corrected_wind, power_density, rotor_equivalent_wind, shear_exponent, square,
)
from galeframe.functions.rowstats import row_mean

TAU = 2.0 * math.pi


def _phase(value: Column, period: float) -> Column:
    return value * (TAU / period)


def _sin_cos(prefix: str, angle: Column) -> dict[str, Column]:
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def calendar_columns(df: DataFrame, *, ts: str = TS, first_year: int = 2022) -> DataFrame:
    """Cyclic hour, day, month and weekday plus weekend, winter and first-quarter flags."""
    t = F.col(ts)
    return df.withColumns({
        **_sin_cos("hour", _phase(F.hour(t), 24.0)),
        **_sin_cos("doy", _phase(F.dayofyear(t), 366.0)),
        **_sin_cos("month", _phase(F.month(t), 12.0)),
        **_sin_cos("dow", _phase(F.weekday(t), 7.0)),
        "is_weekend": flag(F.weekday(t) >= 5),
        "year_index": F.year(t) - first_year,
        "is_winter": flag(F.month(t).isin(12, 1, 2)),
        "is_q1": flag(F.month(t) <= 3),
    })


def direction_columns(df: DataFrame) -> DataFrame:
    """Sine and cosine of the direction at each level; raw values are degrees / 1000."""
    out: dict[str, Column] = {}
    for c in WD_COLS:
        if c in df.columns:
            out |= _sin_cos(f"wind_dir_{c.rsplit('_', 1)[1]}", F.radians(F.col(c) * 1000.0))
    return df.withColumns(out)


def wind_profile_columns(df: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Hub proxy, cubes, squares, shears, shear ratio and gust measures."""
    ws10, ws80, ws120, ws180 = (F.col(c) for c in WS_COLS)
    return df.withColumns({
        "ws_hub_proxy": ws10 * (cfg.hub_height_m / 10.0) ** (1.0 / 7.0),
        **{f"{c}_cube": cube(c) for c in WS_COLS},
        "ws_80m_squared": square(ws80),
        "ws_120m_squared": square(ws120),
        "ws_shear_10_80": ws80 - ws10,
        "ws_shear_80_120": ws120 - ws80,
        "ws_shear_120_180": ws180 - ws120,
        "ws_shear_ratio_80_120": div(ws120, ws80 + 1e-3),
        "gust_ratio_10m": div(GUST, ws10 + 1e-3),
        "gust_excess_10m": clip(F.col(GUST) - ws10, 0.0),
    })


def veer_columns(df: DataFrame) -> DataFrame:
    """Unsigned and signed turning between levels, in radians; needs ``direction_columns``."""
    out: dict[str, Column] = {}
    neighbours = [("10m", "80m"), ("80m", "120m"), ("120m", "180m")]
    for lo, hi in [*neighbours, ("10m", "120m")]:
        s_lo, c_lo = F.col(f"wind_dir_{lo}_sin"), F.col(f"wind_dir_{lo}_cos")
        s_hi, c_hi = F.col(f"wind_dir_{hi}_sin"), F.col(f"wind_dir_{hi}_cos")
        dot = s_lo * s_hi + c_lo * c_hi
        if (lo, hi) in neighbours:
            out[f"veer_{lo}_{hi}"] = F.acos(clip(dot, -1.0, 1.0))
        out[f"veer_signed_{lo}_{hi}"] = F.atan2(s_lo * c_hi - c_lo * s_hi, dot)
    return df.withColumns(out)


def rotor_columns(df: DataFrame) -> DataFrame:
    """Rotor-equivalent wind and its cube."""
    rews = rotor_equivalent_wind("wind_speed_80m", "wind_speed_120m", "wind_speed_180m")
    return df.withColumns({"rews": rews}).withColumns({"rews_cube": cube("rews")})


def density_wind_columns(df: DataFrame) -> DataFrame:
    """Air density, density-corrected wind and power density at 120 m."""
    df = df.withColumns({"air_density": air_density(PRESSURE, "temperature_80m")})
    df = df.withColumns({
        "v_eff": density_corrected_wind("wind_speed_120m", "air_density"),
        "wpd_120m": power_density("wind_speed_120m", "air_density"),
    })
    return df.withColumns({"v_eff_cube": cube("v_eff")})


def shear_exponent_column(df: DataFrame) -> DataFrame:
    return df.withColumns({"hellmann_alpha": shear_exponent("wind_speed_10m", "wind_speed_120m")})


def atmosphere_columns(df: DataFrame) -> DataFrame:
    """Density ratio, temperature gradient, precipitation and icing measures; needs ``air_density``."""
    t80 = F.col("temperature_80m")
    precip = F.col(PRECIP_COLS[0]) + F.col(PRECIP_COLS[1]) + F.col(PRECIP_COLS[2])
    below_two = clip(2.0 - t80, 0.0)
    ratio = F.col("air_density") / RHO_STD
    return df.withColumns({
        "density_ratio": ratio,
        "ws_80m_cube_density": cube("wind_speed_80m") * ratio,
        "ws_120m_cube_density": cube("wind_speed_120m") * ratio,
        "temp_gradient": F.col("temperature_120m") - t80,
        "precip_total": precip,
        "has_precip": flag(precip > 0),
        "icing_risk": flag((t80 < 2) & (precip > 0)),
        "icing_severity": below_two * precip,
        "icing_x_wind": below_two * precip * F.col("wind_speed_120m"),
        "freezing_rain_risk": F.col("rain") * clip(-t80, 0.0),
        "snow_accum_risk": F.col("snowfall") * below_two,
        "rime_ice_proxy": F.col(CLOUD) / 100.0 * below_two * flag(F.col("wind_speed_80m") > 3),
    })


def availability_columns(df: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Active turbines, ratios and, when the wind columns exist, their interactions."""
    n = float(cfg.total_turbines)
    active_ratio = (cfg.total_turbines - F.col(REPAIR)) / n
    out = {
        "active_turbines": cfg.total_turbines - F.col(REPAIR),
        "active_turbines_ratio": active_ratio,
        "maintenance_ratio": F.col(REPAIR) / n,
    }
    for c in ("rews", "v_eff"):
        if c in df.columns:
            out[f"{c}_cube_x_active"] = cube(c) * active_ratio
    return df.withColumns(out)


def sector_hour_columns(df: DataFrame) -> DataFrame:
    """Direction sectors and interactions with hour, shear and availability."""
    deg = F.col("wind_direction_120m") * 1000.0
    angle = _phase(F.hour(TS), 24.0)
    out = {
        "dir_sector_8": sector_clamped(deg, 8),
        "dir_sector_16": sector_clamped(deg, 16),
        "rews_x_sector8": F.col("rews") * sector_clamped(deg, 8),
        "rews_x_hour_sin": F.col("rews") * F.sin(angle),
        "rews_x_hour_cos": F.col("rews") * F.cos(angle),
        "shear_x_gust": (F.col("wind_speed_80m") - F.col("wind_speed_10m")) * F.col(GUST),
    }
    if has(df, "wpd_120m", "active_turbines_ratio"):
        out["wpd_x_active"] = F.col("wpd_120m") * F.col("active_turbines_ratio")
    return df.withColumns(out)


def extra_columns(df: DataFrame) -> DataFrame:
    """Wind components, deep shears, soft regimes and the bulk Richardson number."""
    ws10, ws80, ws120, ws180 = (F.col(c) for c in WS_COLS)
    out = {"ws_shear_10_120": ws120 - ws10, "ws_shear_10_180": ws180 - ws10, "ws_shear_80_180": ws180 - ws80}
    for level, ws in (("120", ws120), ("80", ws80)):
        rad = F.radians(F.col(f"wind_direction_{level}m") * 1000.0)
        out |= {f"ws{level}_u": ws * F.cos(rad), f"ws{level}_v": ws * F.sin(rad)}
    calm, high = clip((4.0 - ws120) / 2.0, 0.0, 1.0), clip((ws120 - 10.0) / 4.0, 0.0, 1.0)
    out |= {"regime_calm": calm, "regime_high": high, "regime_normal": 1.0 - calm - high}
    if has(df, "era5_wind_speed_100m", "era5_wind_direction_100m"):
        rad = F.radians("era5_wind_direction_100m")
        out |= {"era5_ws100_u": F.col("era5_wind_speed_100m") * F.cos(rad),
                "era5_ws100_v": F.col("era5_wind_speed_100m") * F.sin(rad)}
    if has(df, "temperature_80m", "temperature_120m"):
        dz = 40.0
        mean_k = (F.col("temperature_80m") + F.col("temperature_120m")) / 2.0 + KELVIN
        d_temp = (F.col("temperature_120m") - F.col("temperature_80m")) / dz
        d_wind = (ws120 - ws80) / dz
        richardson = (9.81 / mean_k) * d_temp / (d_wind * d_wind + 1e-6)
        out |= {"ri_bulk_80_120": clip(richardson, -10.0, 10.0), "is_stable_bl": flag(richardson > 0.0)}
    return df.withColumns(out)


def curve_power_columns(df: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Farm power, per-turbine power and capacity ratio by wind source, and their consensus."""
    sources = {"wind_speed_80m": "ds_80m", "wind_speed_120m": "ds_120m", "era5_wind_speed_100m": "ds_era5_100m"}
    used = {c: tag for c, tag in sources.items() if c in df.columns}
    df = evaluate_once(df, {f"{tag}_per_turb_kw": turbine_power_kw(c, "air_density") for c, tag in used.items()})
    df = evaluate_once(df, {
        f"{tag}_farm_mw": clip(F.col(f"{tag}_per_turb_kw") * F.col("active_turbines") / 1000.0, 0.0, cfg.capacity_mw)
        for tag in used.values()
    })
    out = {f"{tag}_ratio": F.col(f"{tag}_farm_mw") / cfg.capacity_mw for tag in used.values()}
    if has(df, "ds_80m_farm_mw", "ds_120m_farm_mw"):
        mean = row_mean([f"{tag}_farm_mw" for tag in used.values()])
        out |= {"ds_consensus_farm_mw": mean, "ds_consensus_ratio": mean / cfg.capacity_mw}
    return df.withColumns(out)


def curve_slope_columns(df: DataFrame, *, step: float = 0.5) -> DataFrame:
    """Slope of the power curve at 120 m by central difference, per turbine and per farm."""
    ws, rho = F.col("wind_speed_120m"), zero_if_null("air_density", RHO_STD)
    rise = turbine_power_kw(ws + step, rho) - turbine_power_kw(clip(ws - step, 0.0), rho)
    slope = F.when((ws < 3.0) | (ws > 25.0), F.lit(0.0)).otherwise(rise / (2.0 * step))
    df = evaluate_once(df, {"struct_pc_slope_kw_per_ms": slope})
    return df.withColumns({
        "struct_pc_slope_farm_mw": F.col("struct_pc_slope_kw_per_ms") * F.col("active_turbines") / 1000.0
    })


def farm_slope_columns(df: DataFrame, *, step: float = 0.5) -> DataFrame:
    """Non-negative farm slope and its interactions with rolling wind and icing."""
    ws = F.col("wind_speed_120m")
    rise = turbine_power_kw(ws + step, "air_density") - turbine_power_kw(ws - step, "air_density")
    df = evaluate_once(df, {"_rise_kw": rise}).withColumns({
        "ds_pc_slope_mw_per_ms": clip(F.col("_rise_kw") * F.col("active_turbines") / 1000.0, 0.0) / (2.0 * step),
        "ds_steep_zone": flag((ws >= 7.0) & (ws <= 10.5)),
    })
    df, out = df.drop("_rise_kw"), {}
    for c, name in (("era5_ws100_roll_mean_6h", "ds_slope_x_roll6h"), ("icing_severity", "ds_slope_x_icing")):
        if c in df.columns:
            out[name] = F.col("ds_pc_slope_mw_per_ms") * F.col(c)
    return df.withColumns(out) if out else df


def ramp_power_columns(df: DataFrame) -> DataFrame:
    """Wind change times curve slope; needs ``curve_slope_columns`` and the ramp columns."""
    if not has(df, "struct_pc_slope_farm_mw", "dv_3h", "dv_6h"):
        raise KeyError("ramp_power_columns needs struct_pc_slope_farm_mw, dv_3h and dv_6h")
    return df.withColumns({
        f"struct_ramp_{h}h_power_mw": F.col("struct_pc_slope_farm_mw") * F.col(f"dv_{h}h") for h in (3, 6)
    })


def smeared_power_columns(df: DataFrame, deltas=(1, 2, 3, 4), cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Mean power at v - d and v + d for each d, and its excess over the power at v."""
    ws = F.col("wind_speed_120m")
    tag = {d: f"smear_p{float(d)}".replace(".", "") for d in deltas}
    df = evaluate_once(df, {
        "_point_mw": farm_power_mw(ws, "air_density", "active_turbines", cfg),
        **{f"{tag[d]}_per_turb_kw": (turbine_power_kw(ws - float(d), "air_density")
                                     + turbine_power_kw(ws + float(d), "air_density")) / 2.0 for d in deltas},
    })
    df = df.withColumns({
        f"{tag[d]}_farm_mw": clip(F.col(f"{tag[d]}_per_turb_kw") * F.col("active_turbines") / 1000.0,
                                  0.0, cfg.capacity_mw) for d in deltas
    })
    return df.withColumns({
        f"{tag[d]}_excess_mw": F.col(f"{tag[d]}_farm_mw") - F.col("_point_mw") for d in deltas
    }).drop("_point_mw")


def hub_wind_columns(df: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Wind at the rotor hub from the mean shear of up to three layers, and its power."""
    if not has(df, "wind_speed_120m", "wind_speed_10m", "air_density", "active_turbines"):
        return df
    v = {h: clip(f"wind_speed_{h}m", 0.1) for h in (10, 80, 120) if f"wind_speed_{h}m" in df.columns}
    layers = [(lo, hi) for lo, hi in ((10, 120), (80, 120), (10, 80)) if lo in v and hi in v]
    shears = [clip(F.ln(v[hi] / v[lo]) / math.log(hi / lo), 0.05, 0.50) for lo, hi in layers]
    df = evaluate_once(df, {"shear_exp_consensus": sum(shears[1:], shears[0]) / float(len(shears))})
    df = df.withColumns({
        "wind_speed_85m_pl": v[120] * F.pow(F.lit(cfg.rotor_hub_m / 120.0), F.col("shear_exp_consensus"))
    })
    df = evaluate_once(df, {"ds_85m_pl_farm_mw": farm_power_mw("wind_speed_85m_pl", "air_density", "active_turbines", cfg)})
    out = {"ds_85m_pl_ratio": F.col("ds_85m_pl_farm_mw") / cfg.capacity_mw}
    if "ds_120m_farm_mw" in df.columns:
        out["ds_85m_vs_120m_mw"] = F.col("ds_85m_pl_farm_mw") - F.col("ds_120m_farm_mw")
    return df.withColumns(out)


def surface_density_columns(df: DataFrame) -> DataFrame:
    """Density from surface pressure ``sp`` and temperature ``t2m``, whatever their unit.

    The unit is told from the table's median: pressure under 2,000 is hPa,
    temperature under 100 is Celsius. Both medians are exact.
    """
    if not has(df, "sp", "t2m"):
        return df
    from galeframe.operators.ranks import table_medians

    medians = table_medians(df, {"sp": 1.0, "t2m": 0.1})
    sp_is_hpa, t_is_celsius = medians["sp"] < 2_000.0, medians["t2m"] < 100.0
    df = df.withColumns({
        "_pa": F.when(sp_is_hpa, F.col("sp") * 100.0).otherwise(F.col("sp")),
        "_k": F.when(t_is_celsius, F.col("t2m") + KELVIN).otherwise(F.col("t2m")),
    })
    df = df.withColumns({"air_density": F.col("_pa") / (R_DRY_PRECISE * F.col("_k"))})
    ratio = F.col("air_density") / RHO_STD
    out = {"density_ratio": ratio, "t2m_vs_iso": F.col("_k") - 288.15}
    for c, label in (("wind_speed_120m", "120m"), ("v_eff", "veff")):
        if c in df.columns:
            out[f"{c}_rho_corrected"] = F.col(c) * F.pow(ratio, F.lit(1.0 / 3.0))
            out[f"kinetic_power_{label}"] = F.col("air_density") * 0.5 * cube(c)
    for c in ("ds_120m_farm_mw", "ds_85m_pl_farm_mw"):
        if c in df.columns:
            out[f"{c}_rho"] = F.col(c) * ratio
    return df.withColumns(out).drop("_pa", "_k")


def relative_density_columns(df: DataFrame) -> DataFrame:
    """Relative density from 120 m temperature and sea-level pressure, applied to each wind."""
    if not has(df, "temperature_120m", PRESSURE):
        return df
    df = df.withColumns({"air_density_norm": air_density(PRESSURE, "temperature_120m", R_DRY_PRECISE) / RHO_STD})
    root = F.cbrt("air_density_norm")
    out = {}
    if "wind_speed_120m" in df.columns:
        out["v120_density"] = F.col("wind_speed_120m") * root
        out["wpd_density"] = cube("wind_speed_120m") * F.col("air_density_norm")
    for c in ("v_eff", "gfs_ws100m", "ecmwf_ws100m"):
        if c in df.columns:
            out[f"{c}_density"] = F.col(c) * root
    return df.withColumns(out)


def diurnal_columns(df: DataFrame, *, ts: str = TS) -> DataFrame:
    """Time of day in fractional hours, day and night flags and their wind interactions."""
    hour = F.hour(ts) + F.minute(ts) / 60.0
    df = df.withColumns({**_sin_cos("hour", _phase(hour, 24.0)), "is_day": flag((hour >= 6) & (hour < 20))})
    out = {}
    for c in ("wind_speed_120m", "v_eff"):
        if c in df.columns:
            out[f"hour_sin_x_{c}"] = F.col("hour_sin") * F.col(c)
            out[f"hour_cos_x_{c}"] = F.col("hour_cos") * F.col(c)
    if "wind_speed_120m" in df.columns:
        ws = F.col("wind_speed_120m")
        out["hour_x_wpd"] = F.col("hour_cos") * cube(ws)
        out["daytime_ws"] = ws * F.col("is_day")
        out["night_ws"] = ws * (1 - F.col("is_day"))
    return df.withColumns(out)


def seasonal_columns(df: DataFrame, *, ts: str = TS) -> DataFrame:
    """Month and winter interactions with wind."""
    if "wind_speed_120m" not in df.columns:
        return df
    month, ws = F.month(ts), F.col("wind_speed_120m")
    v = F.col("v_eff") if "v_eff" in df.columns else ws
    winter = flag(month.isin(1, 2, 3))
    angle = _phase(month, 12.0)
    return df.withColumns({
        "month_sin_x_veff": F.sin(angle) * v,
        "month_cos_x_veff": F.cos(angle) * v,
        "is_winter_x_veff": winter * v,
        "is_winter_x_ws120": winter * ws,
        "month_x_ws120": month * ws,
        "season_x_wpd": winter * cube(v),
    })


def regime_columns(df: DataFrame, *, ts: str = TS) -> DataFrame:
    """Soft and hard membership in the wind regimes, night flag and interactions."""
    if "wind_speed_120m" not in df.columns:
        return df
    ws = F.col("wind_speed_120m")
    df = df.withColumns({
        "regime_sub_cutin": 1.0 - clip(ws / 3.0, 0.0, 1.0),
        "regime_steep": clip((ws - 7.0) / 3.0, 0.0, 1.0) * (1.0 - clip((ws - 10.0) / 2.0, 0.0, 1.0)),
        "regime_rated": clip((ws - 12.0) / 2.0, 0.0, 1.0),
        "regime_steep_flag": flag((ws >= 7.0) & (ws < 10.0)),
        "regime_rated_flag": flag(ws >= 12.0),
    })
    out = {}
    for c, name, by in (
        ("ens3_ws100_std", "spread_x_steep", "regime_steep"), ("ens3_ws100_std", "spread_x_rated", "regime_rated"),
        ("hellmann_alpha", "alpha_x_steep", "regime_steep"), ("ri_bulk_80_120", "ri_x_steep", "regime_steep"),
    ):
        if c in df.columns:
            out[name] = F.col(c) * F.col(by)
    if ts in df.columns:
        night = flag((F.hour(ts) >= 20) | (F.hour(ts) <= 3))
        out["is_night"] = night
        out["night_x_ws120"] = night * ws
        if "air_density" in df.columns:
            out["night_density"] = night * F.col("air_density")
    return df.withColumns(out)


def steep_flag() -> Column:
    ws = F.col("wind_speed_120m")
    return flag((ws >= 7.0) & (ws <= 10.0))


def steep_zone_columns(df: DataFrame) -> DataFrame:
    """Convexity correction, coefficient of variation, cubic spread and steep-zone products."""
    steep, out = steep_flag(), {}
    if has(df, "ens3_ws100_std", "wind_speed_120m"):
        ratio = F.col("ens3_ws100_std") / clip("wind_speed_120m", 0.5)
        out |= {"jensen_correction": 3.0 * ratio * ratio, "steep_zone_flag": steep,
                "steep_x_jensen": steep * (3.0 * ratio * ratio)}
    if has(df, "ens3_ws100_std", "ens3_ws100_mean"):
        cv = F.col("ens3_ws100_std") / clip("ens3_ws100_mean", 0.1)
        out |= {"wind_cv": cv, "steep_x_wind_cv": steep * cv}
    if has(df, "gfs_ws100m_cube", "ecmwf_ws100m_cube"):
        gap = F.abs(F.col("gfs_ws100m_cube") - F.col("ecmwf_ws100m_cube"))
        out |= {"cube_gfs_ecmwf_diff": gap, "steep_x_cube_diff": steep * gap}
    for c in ("ens3_spread_roll6h_mean", "ens3_spread_roll12h_mean", "dir_stability_6h",
              "gfs_dir_instability_12h", "gfs_ecmwf_dir_diff"):
        if c in df.columns:
            out[f"steep_x_{c}"] = steep * F.col(c)
    return df.withColumns(out) if out else df


def to_capacity_factor(df: DataFrame, *, mw: str = TARGET, active: str = "active_turbines", out: str = "cf",
                       cfg: FarmConfig = DEFAULT) -> DataFrame:
    rated = F.greatest(F.col(active) * cfg.turbine_rated_mw, F.lit(1e-3))
    return df.withColumns({out: F.col(mw) / rated})


def from_capacity_factor(df: DataFrame, *, cf: str = "cf", active: str = "active_turbines", out: str = "cf_mw",
                         cfg: FarmConfig = DEFAULT) -> DataFrame:
    return df.withColumns({out: clip(cf, 0.0, 1.0) * F.col(active) * cfg.turbine_rated_mw})


def logit_columns(df: DataFrame, *, cf: str = "cf", eps: float = 1e-3) -> DataFrame:
    """Logit of the capacity factor and the value mapped back."""
    p = clip(cf, eps, 1.0 - eps)
    df = df.withColumns({"cf_logit": F.ln(p / (1.0 - p))})
    return df.withColumns({"cf_from_logit": 1.0 / (1.0 + F.exp(-F.col("cf_logit")))})


def numeric_feature_names(df: DataFrame, *, exclude: tuple[str, ...] = (TS, TARGET, "_submission_row", "_source")) -> list[str]:
    """Names of the numeric columns usable as model inputs, in table order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if n not in exclude and (t in kinds or t.startswith("decimal"))]


