"""Queries over the row-wise weather and power-curve operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TS
from galeframe.operators import reanalysis, weather
from galeframe.operators.windows import ramp_columns
from galeframe.plans.frames import added, base, only, with_feed
from galeframe.plans.oracle.base import (
    BASE, HOURLY, clip, cols, curve_ctes, feed_cte, rho, with_,
)
from galeframe.plans.registry import query
from galeframe.sources.derived import feed, hourly

PI = "3.141592653589793e0"


def _sc(prefix: str, angle: str) -> dict[str, str]:
    return {f"{prefix}_sin": f"sin({angle})", f"{prefix}_cos": f"cos({angle})"}


def _rad(level: str) -> str:
    return f"radians(wind_direction_{level}*1000.0e0)"


def _b(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _frac(num: str, den: str) -> str:
    return f"({num})/({den})"


@query("P01_calendar", with_(HOURLY) + "SELECT " + cols(
    {**_sc("hour", f"2*{PI}*hour(ts)/24.0e0"), **_sc("doy", f"2*{PI}*dayofyear(ts)/366.0e0"),
     **_sc("month", f"2*{PI}*month(ts)/12.0e0"), **_sc("dow", f"2*{PI}*(isodow(ts)-1)/7.0e0")},
    {"is_weekend": _b("isodow(ts) >= 6"), "year_index": "year(ts)-2022", "is_winter": _b("month(ts) IN (12,1,2)"),
     "is_q1": _b("month(ts) IN (1,2,3)")}) + " FROM hourly")
def calendar(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.calendar_columns(h))


@query("P02_direction", with_(HOURLY) + "SELECT " + cols(
    {k: v for lv in ("10m", "80m", "120m", "180m") for k, v in _sc(f"wind_dir_{lv}", _rad(lv)).items()}) + " FROM hourly")
def direction(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.direction_columns(h))


@query("P03_wind_profile", with_(HOURLY) + "SELECT " + cols({
    "ws_hub_proxy": "wind_speed_10m*pow(8.0e0, 1.0e0/7.0e0)",
    **{f"wind_speed_{lv}_cube": f"wind_speed_{lv}*wind_speed_{lv}*wind_speed_{lv}" for lv in ("10m", "80m", "120m", "180m")},
    "ws_80m_squared": "wind_speed_80m*wind_speed_80m", "ws_120m_squared": "wind_speed_120m*wind_speed_120m",
    "ws_shear_10_80": "wind_speed_80m-wind_speed_10m", "ws_shear_80_120": "wind_speed_120m-wind_speed_80m",
    "ws_shear_120_180": "wind_speed_180m-wind_speed_120m",
    "ws_shear_ratio_80_120": "wind_speed_120m/(wind_speed_80m+0.001e0)",
    "gust_ratio_10m": "wind_gusts_10m/(wind_speed_10m+0.001e0)",
    "gust_excess_10m": "greatest(0.0e0, wind_gusts_10m-wind_speed_10m)"}) + " FROM hourly")
def wind_profile(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.wind_profile_columns(h))


def _veer_sql() -> str:
    d = {}
    for lo, hi in (("10m", "80m"), ("80m", "120m"), ("120m", "180m")):
        d[f"veer_{lo}_{hi}"] = f"acos(least(1.0e0, greatest(-1.0e0, cos({_rad(lo)}-{_rad(hi)}))))"
    for lo, hi in (("10m", "80m"), ("80m", "120m"), ("120m", "180m"), ("10m", "120m")):
        a = f"({_rad(lo)}-{_rad(hi)})"
        d[f"veer_signed_{lo}_{hi}"] = f"atan2(sin({a}), cos({a}))"
    # least/greatest skip NULL, so an absent level is masked here.
    for k in d:
        if "180m" in k and not k.startswith("veer_signed"):
            d[k] = f"CASE WHEN wind_direction_180m IS NOT NULL THEN {d[k]} END"
    return with_(HOURLY) + "SELECT " + cols(d) + " FROM hourly"


@query("P04_veer", _veer_sql())
def veer(spark, sf):
    h = weather.direction_columns(hourly(spark, sf))
    return added(h, weather.veer_columns(h))


@query("P05_rotor_wind", with_(HOURLY) + """, x AS (SELECT *,
  (pow(wind_speed_80m,3)+pow(wind_speed_120m,3)+pow(wind_speed_180m,3))/3.0e0 AS c3 FROM hourly)
SELECT """ + cols({"rews": "pow(c3, 1.0e0/3.0e0)", "rews_cube": "c3"}) + " FROM x")
def rotor_wind(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.rotor_columns(h))


@query("P06_density", with_(HOURLY) + f", x AS (SELECT *, {rho()} AS d FROM hourly) SELECT " + cols({
    "air_density": "d", "v_eff": "wind_speed_120m*cbrt(d/1.225e0)",
    "wpd_120m": "0.5e0*d*wind_speed_120m*wind_speed_120m*wind_speed_120m",
    "v_eff_cube": "pow(wind_speed_120m, 3)*d/1.225e0"}) + " FROM x")
def density(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.density_wind_columns(h))


@query("P07_shear_exponent", with_(HOURLY) + "SELECT " + cols({"hellmann_alpha":
    "least(0.7e0, greatest(-0.3e0, ln(least(10.0e0, greatest(0.1e0,"
    " greatest(wind_speed_120m,0.1e0)/greatest(wind_speed_10m,0.1e0))))/ln(12.0e0)))"}) + " FROM hourly")
def shear(spark, sf):
    h = hourly(spark, sf)
    return added(h, weather.shear_exponent_column(h))


@query("P08_atmosphere", with_(BASE) + """, x AS (SELECT *, rain+showers+snowfall AS p,
  greatest(0.0e0, 2.0e0-temperature_80m) AS cold, air_density/1.225e0 AS dr FROM base) SELECT """ + cols({
    "density_ratio": "dr", "ws_80m_cube_density": "pow(wind_speed_80m,3)*dr", "ws_120m_cube_density": "pow(wind_speed_120m,3)*dr",
    "temp_gradient": "temperature_120m-temperature_80m", "precip_total": "p", "icing_severity": "cold*p",
    "icing_x_wind": "cold*p*wind_speed_120m", "freezing_rain_risk": "rain*greatest(0.0e0, -temperature_80m)",
    "snow_accum_risk": "snowfall*cold",
    "rime_ice_proxy": "CASE WHEN wind_speed_80m > 3 THEN cloud_cover_low/100.0e0*cold ELSE 0 END"},
    {"has_precip": _b("p > 0"), "icing_risk": _b("temperature_80m < 2 AND p > 0")}) + " FROM x")
def atmosphere(spark, sf):
    b = base(spark, sf)
    return added(b, weather.atmosphere_columns(b))


@query("P09_availability", with_(BASE) + "SELECT " + cols({
    "active_turbines_ratio": "1-n_repair/26.0e0", "maintenance_ratio": "n_repair/26.0e0",
    "rews_cube_x_active": "(pow(wind_speed_80m,3)+pow(wind_speed_120m,3)+pow(wind_speed_180m,3))/3.0e0*(26-n_repair)/26.0e0",
    "v_eff_cube_x_active": "pow(wind_speed_120m,3)*air_density/1.225e0*(26-n_repair)/26.0e0"},
    {"active_turbines": "26-n_repair"}) + " FROM base")
def availability(spark, sf):
    h = weather.density_wind_columns(weather.rotor_columns(hourly(spark, sf)))
    return added(h, weather.availability_columns(h))


@query("P10_sector_hour", with_(BASE) + """, x AS (SELECT *, wind_direction_120m*1000.0e0 AS deg,
  cbrt((pow(wind_speed_80m,3)+pow(wind_speed_120m,3)+pow(wind_speed_180m,3))/3.0e0) AS rews,
  0.5e0*air_density*pow(wind_speed_120m,3) AS wpd FROM base),
 y AS (SELECT *, least(7, CAST(floor(deg/45.0e0) AS INT)) AS s8, least(15, CAST(floor(deg/22.5e0) AS INT)) AS s16 FROM x)
SELECT """ + cols({"rews_x_sector8": "rews*s8", "rews_x_hour_sin": f"rews*sin(2*{PI}*hour(ts)/24.0e0)",
    "rews_x_hour_cos": f"rews*cos(2*{PI}*hour(ts)/24.0e0)", "shear_x_gust": "(wind_speed_80m-wind_speed_10m)*wind_gusts_10m",
    "wpd_x_active": "wpd*active_turbines_ratio"}, {"dir_sector_8": "s8", "dir_sector_16": "s16"}) + " FROM y")
def sector_hour(spark, sf):
    b = weather.rotor_columns(weather.density_wind_columns(base(spark, sf)))
    return added(b, weather.sector_hour_columns(b))


@query("P11_extras", with_(HOURLY, feed_cte("reanalysis")) + """, x AS (SELECT h.*, e.wind_speed_100m AS e100, e.wind_direction_100m AS ed,
  (9.81e0/((h.temperature_80m+h.temperature_120m)/2.0e0+273.15e0))*((h.temperature_120m-h.temperature_80m)/40.0e0)
   /(pow((h.wind_speed_120m-h.wind_speed_80m)/40.0e0, 2)+1e-6) AS ri
  FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts)) SELECT """ + cols({
    "ws_shear_10_120": "wind_speed_120m-wind_speed_10m", "ws_shear_10_180": "wind_speed_180m-wind_speed_10m",
    "ws_shear_80_180": "wind_speed_180m-wind_speed_80m",
    "ws120_u": f"wind_speed_120m*cos({_rad('120m')})", "ws120_v": f"wind_speed_120m*sin({_rad('120m')})",
    "ws80_u": f"wind_speed_80m*cos({_rad('80m')})", "ws80_v": f"wind_speed_80m*sin({_rad('80m')})",
    "regime_calm": "least(1.0e0, greatest(0.0e0, (4-wind_speed_120m)/2.0e0))",
    "regime_high": "least(1.0e0, greatest(0.0e0, (wind_speed_120m-10)/4.0e0))",
    "regime_normal": "1-least(1.0e0, greatest(0.0e0, (4-wind_speed_120m)/2.0e0))-least(1.0e0, greatest(0.0e0, (wind_speed_120m-10)/4.0e0))",
    "era5_ws100_u": "e100*cos(radians(ed))", "era5_ws100_v": "e100*sin(radians(ed))",
    "ri_bulk_80_120": "least(10.0e0, greatest(-10.0e0, ri))"}, {"is_stable_bl": _b("ri > 0")}) + " FROM x")
def extras(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, weather.extra_columns(h))




def _mw(k: str) -> str:
    return clip(f"({k})*active_turbines/1000.0e0", "0.0e0", "90.09e0")


@query("P12_turbine_power", with_(BASE, curve_ctes("base", "x", {"k80": ("wind_speed_80m", "air_density"), "k120": ("wind_speed_120m", "air_density"),
       "k_gust": ("wind_gusts_10m", "air_density"), "k180": ("wind_speed_180m", "air_density")}))
       + "SELECT " + cols({"kw_80m": "k80", "kw_120m": "k120", "kw_gust": "k_gust", "kw_180m": "k180"}) + " FROM x")
def turbine_power(spark, sf):
    from galeframe.functions.curve import turbine_power_kw
    b = base(spark, sf)
    return b.select(SITE, TS, *[turbine_power_kw(c, "air_density").alias(n) for c, n in (
        ("wind_speed_80m", "kw_80m"), ("wind_speed_120m", "kw_120m"), ("wind_gusts_10m", "kw_gust"), ("wind_speed_180m", "kw_180m"))])


_P13 = with_(BASE, feed_cte("reanalysis"), "j AS (SELECT b.*, e.wind_speed_100m AS e100 FROM base b LEFT JOIN reanalysis e USING (site_id, ts))",
             curve_ctes("j", "k", {"k80": ("wind_speed_80m", "air_density"), "k120": ("wind_speed_120m", "air_density"), "ke": ("e100", "air_density")}),
             f"x AS (SELECT *, {_mw('k80')} AS m80, {_mw('k120')} AS m120, {_mw('ke')} AS me FROM k)")


@query("P13_farm_power", _P13 + "SELECT " + cols({
    "ds_80m_farm_mw": "m80", "ds_80m_per_turb_kw": "k80", "ds_80m_ratio": "m80/90.09e0",
    "ds_120m_farm_mw": "m120", "ds_120m_per_turb_kw": "k120", "ds_120m_ratio": "m120/90.09e0",
    "ds_era5_100m_farm_mw": "me", "ds_era5_100m_per_turb_kw": "ke", "ds_era5_100m_ratio": "me/90.09e0",
    "ds_consensus_farm_mw": "list_avg([m80, m120, me])", "ds_consensus_ratio": "list_avg([m80, m120, me])/90.09e0"}) + " FROM x")
def farm_power(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "era5")
    return added(b, weather.curve_power_columns(b))


_SLOPE = ("base", "k", {"kp": ("wind_speed_120m+0.5e0", "air_density"), "km": ("greatest(0.0e0, wind_speed_120m-0.5e0)", "air_density")})


@query("P14_curve_slope", with_(BASE, curve_ctes(*_SLOPE), """x AS (SELECT *,
  CASE WHEN wind_speed_120m < 3 OR wind_speed_120m > 25 THEN 0.0e0 ELSE kp-km END AS slope FROM k)""") + "SELECT " + cols({
    "struct_pc_slope_kw_per_ms": "slope", "struct_pc_slope_farm_mw": "slope*active_turbines/1000.0e0",
    "ds_pc_slope_mw_per_ms": "greatest(0.0e0, (kp-km)*active_turbines/1000.0e0)",
    "ds_slope_x_icing": "greatest(0.0e0, (kp-km)*active_turbines/1000.0e0)*greatest(0.0e0, 2-temperature_80m)*(rain+showers+snowfall)"},
    {"ds_steep_zone": _b("wind_speed_120m BETWEEN 7 AND 10.5")}) + " FROM x")
def curve_slope(spark, sf):
    b = weather.atmosphere_columns(base(spark, sf))
    return added(b, weather.farm_slope_columns(weather.curve_slope_columns(b)))


@query("P15_ramp_power", with_(BASE, curve_ctes(*_SLOPE), """x AS (SELECT *,
  CASE WHEN wind_speed_120m < 3 OR wind_speed_120m > 25 THEN 0.0e0 ELSE kp-km END*active_turbines/1000.0e0 AS slope,
  coalesce(wind_speed_120m-lag(wind_speed_120m, 3) OVER w, 0) AS d3, coalesce(wind_speed_120m-lag(wind_speed_120m, 6) OVER w, 0) AS d6
  FROM k WINDOW w AS (PARTITION BY site_id ORDER BY ts))""") + "SELECT " + cols({
    "struct_ramp_3h_power_mw": "slope*d3", "struct_ramp_6h_power_mw": "slope*d6"}) + " FROM x")
def ramp_power(spark, sf):
    b = weather.curve_slope_columns(ramp_columns(base(spark, sf)))
    return added(b, weather.ramp_power_columns(b))


def _smear() -> str:
    pairs = {"k0": ("wind_speed_120m", "air_density")}
    for d in (1, 2, 3, 4):
        pairs[f"lo{d}"] = (f"wind_speed_120m-{d}", "air_density")
        pairs[f"hi{d}"] = (f"wind_speed_120m+{d}", "air_density")
    out = {}
    for d in (1, 2, 3, 4):
        kw = f"(lo{d}+hi{d})/2.0e0"
        out |= {f"smear_p{d}0_per_turb_kw": kw, f"smear_p{d}0_farm_mw": _mw(kw), f"smear_p{d}0_excess_mw": f"{_mw(kw)}-{_mw('k0')}"}
    return with_(BASE, curve_ctes("base", "x", pairs)) + "SELECT " + cols(out) + " FROM x"


@query("P16_smeared_power", _smear())
def smeared_power(spark, sf):
    b = base(spark, sf)
    return added(b, weather.smeared_power_columns(b))


def _lim(a: str, b: str, h: str) -> str:
    return f"least(0.5e0, greatest(0.05e0, ln({b}/{a})/ln({h})))"


@query("P17_hub_wind", with_(BASE, f"""y0 AS (SELECT *, greatest(wind_speed_10m,0.1e0) AS a, greatest(wind_speed_80m,0.1e0) AS b,
  greatest(wind_speed_120m,0.1e0) AS c FROM base)""",
    f"y AS (SELECT *, ({_lim('a', 'c', '12.0e0')}+{_lim('b', 'c', '1.5e0')}+{_lim('a', 'b', '8.0e0')})/3.0e0 AS mm FROM y0)",
    "z AS (SELECT *, c*pow(85.0e0/120.0e0, mm) AS vh FROM y)",
    curve_ctes("z", "x", {"kh": ("vh", "air_density"), "k120": ("wind_speed_120m", "air_density")})) + "SELECT " + cols({
    "shear_exp_consensus": "mm", "wind_speed_85m_pl": "vh", "ds_85m_pl_farm_mw": _mw("kh"),
    "ds_85m_pl_ratio": f"{_mw('kh')}/90.09e0", "ds_85m_vs_120m_mw": f"{_mw('kh')}-{_mw('k120')}"}) + " FROM x")
def hub_wind(spark, sf):
    b = weather.curve_power_columns(base(spark, sf))
    return added(b, weather.hub_wind_columns(b))


@query("P18_surface_density", with_(BASE, feed_cte("merra"), """j AS (SELECT b.*, n.ps AS sp0, n.t2m AS t0 FROM base b LEFT JOIN merra n USING (site_id, ts))""",
    """u AS (SELECT *, sp0*CASE WHEN (SELECT median(sp0) FROM j) < 2000 THEN 100 ELSE 1 END AS pa,
      t0+CASE WHEN (SELECT median(t0) FROM j) < 100 THEN 273.15e0 ELSE 0 END AS tk FROM j)""",
    "x AS (SELECT *, pa/(287.058e0*tk) AS d FROM u)") + "SELECT " + cols({
    "air_density": "d", "density_ratio": "d/1.225e0", "t2m_vs_iso": "tk-288.15e0",
    "wind_speed_120m_rho_corrected": "wind_speed_120m*cbrt(d/1.225e0)", "kinetic_power_120m": "0.5e0*d*pow(wind_speed_120m,3)",
    "v_eff_rho_corrected": "v_eff*cbrt(d/1.225e0)", "kinetic_power_veff": "0.5e0*d*pow(v_eff,3)"}) + " FROM x")
def surface_density(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "nasa").withColumnsRenamed({"nasa_ps": "sp", "nasa_t2m": "t2m"})
    out = weather.surface_density_columns(b)
    return only(out, "air_density", "density_ratio", "t2m_vs_iso", "wind_speed_120m_rho_corrected", "kinetic_power_120m",
                "v_eff_rho_corrected", "kinetic_power_veff")


@query("P19_relative_density", with_(BASE, feed_cte("gfs"), feed_cte("ecmwf"), f"""x AS (SELECT b.*, g.wind_speed_100m AS g100, e.wind_speed_100m AS e100,
  {rho('b.pressure_msl', 'b.temperature_120m', '287.058e0')}/1.225e0 AS n FROM base b LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf e USING (site_id, ts))""")
    + "SELECT " + cols({"air_density_norm": "n", "v120_density": "wind_speed_120m*cbrt(n)", "wpd_density": "pow(wind_speed_120m,3)*n",
    "v_eff_density": "v_eff*cbrt(n)", "gfs_ws100m_density": "g100*cbrt(n)", "ecmwf_ws100m_density": "e100*cbrt(n)"}) + " FROM x")
def relative_density(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "gfs", "ecmwf")
    return added(b, weather.relative_density_columns(b))


@query("P20_diurnal", with_(BASE, f"""x AS (SELECT *, 2*{PI}*(hour(ts)+minute(ts)/60.0e0)/24.0e0 AS a,
  CASE WHEN hour(ts) BETWEEN 6 AND 19 THEN 1 ELSE 0 END AS d FROM base)""") + "SELECT " + cols({
    **_sc("hour", "a"), "hour_sin_x_wind_speed_120m": "sin(a)*wind_speed_120m", "hour_cos_x_wind_speed_120m": "cos(a)*wind_speed_120m",
    "hour_sin_x_v_eff": "sin(a)*v_eff", "hour_cos_x_v_eff": "cos(a)*v_eff", "hour_x_wpd": "cos(a)*pow(wind_speed_120m,3)",
    "daytime_ws": "wind_speed_120m*d", "night_ws": "wind_speed_120m*(1-d)"}, {"is_day": "d"}) + " FROM x")
def diurnal(spark, sf):
    b = base(spark, sf)
    return added(b, weather.diurnal_columns(b))


@query("P21_seasonal", with_(BASE, f"""x AS (SELECT *, 2*{PI}*month(ts)/12.0e0 AS a, CASE WHEN quarter(ts) = 1 THEN 1 ELSE 0 END AS w FROM base)""")
    + "SELECT " + cols({"month_sin_x_veff": "sin(a)*v_eff", "month_cos_x_veff": "cos(a)*v_eff", "is_winter_x_veff": "w*v_eff",
    "is_winter_x_ws120": "w*wind_speed_120m", "month_x_ws120": "month(ts)*wind_speed_120m", "season_x_wpd": "w*pow(v_eff,3)"}) + " FROM x")
def seasonal(spark, sf):
    b = base(spark, sf)
    return added(b, weather.seasonal_columns(b))


@query("P22_reanalysis", with_(BASE, feed_cte("reanalysis"), f"""x AS (SELECT b.*, e.wind_speed_100m AS w, e.wind_speed_10m AS w10, e.wind_gusts_10m AS g,
  e.temperature_2m AS t, e.cloud_cover_low AS cl, e.rain AS er, e.wind_direction_100m AS dd,
  {rho('e.pressure_msl', 'e.temperature_2m')} AS d FROM base b LEFT JOIN reanalysis e USING (site_id, ts))""",
    """y AS (SELECT *, w*cbrt(d/1.225e0) AS ve, CASE WHEN dd IS NOT NULL THEN least(1.0e0, greatest(-1.0e0,
      cos(radians(wind_direction_120m*1000.0e0)-radians(dd)))) END AS ag FROM x)""") + "SELECT " + cols({
    "era5_air_density": "d", "era5_v_eff": "ve", "era5_wpd": "0.5e0*d*pow(w,3)", "nwp_era5_dir_agreement": "ag",
    "era5_density_ratio": "d/1.225e0", "era5_v_eff_cube": "pow(ve,3)", "era5_v_eff_cube_x_active": "pow(ve,3)*active_turbines_ratio",
    "era5_wpd_x_active": "0.5e0*d*pow(w,3)*active_turbines_ratio", "era5_shear_10_100": "w-w10", "era5_shear_ratio_10_100": "w/(w10+0.001e0)",
    "era5_gust_ratio_10m": "g/(w10+0.001e0)", "era5_gust_excess_10m": clip("g-w10", "0.0e0"), "ws80_vs_era5_100": "wind_speed_80m-w",
    "ws120_vs_era5_100": "wind_speed_120m-w", "ws180_vs_era5_100": "wind_speed_180m-w", "temp_vs_era5": "temperature_80m-t",
    "nwp_era5_dir_diff": "acos(ag)", "era5_dir_sector_8": "CAST(floor(dd/45.0e0) AS INT)%8", "era5_dir_sector_16": "CAST(floor(dd/22.5e0) AS INT)%16",
    "era5_v_eff_x_sector": "ve*(CAST(floor(dd/45.0e0) AS INT)%8)", "era5_cloud_cover_norm": "cl/100.0e0", "precip_vs_era5_rain": "rain-er"}) + " FROM y")
def reanalysis_set(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "era5")
    out = added(b, reanalysis.reanalysis_columns(b))
    return out.withColumns({c: F.col(c).cast("double") for c in ("era5_dir_sector_8", "era5_dir_sector_16")})


@query("P23_direction_disagreement", with_(HOURLY, feed_cte("reanalysis"), """x AS (SELECT h.site_id, h.ts,
  h.wind_direction_120m*1000.0e0-e.wind_direction_100m AS g FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    "nwp_era5_dir_agreement": "cos(radians(g))", "nwp_era5_dir_diff_deg": "CASE WHEN abs(g) <= 180 THEN abs(g) ELSE 360-abs(g) END",
    "nwp_era5_dir_signed_diff": "CASE WHEN g >= 180 THEN g-360 WHEN g < -180 THEN g+360 ELSE g END"}) + " FROM x")
def direction_disagreement(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, reanalysis.direction_disagreement_columns(h))


_V2 = with_(BASE, feed_cte("reanalysis_v2"), feed_cte("merra"), """x AS (SELECT b.*, v.* EXCLUDE (site_id, ts, air_density, wind_speed_120m),
  v.air_density AS v_rho, v.wind_speed_120m AS v120, n.rh2m, n.slp, n.ps, n.z0m, n.disph,
  b.wind_speed_180m-b.wind_speed_80m AS sh80_180, b.wind_speed_80m-b.wind_speed_10m AS sh10_80,
  cbrt((pow(b.wind_speed_80m,3)+pow(b.wind_speed_120m,3)+pow(b.wind_speed_180m,3))/3.0e0) AS rews,
  least(10.0e0, greatest(-10.0e0, (9.81e0/((b.temperature_80m+b.temperature_120m)/2.0e0+273.15e0))*((b.temperature_120m-b.temperature_80m)/40.0e0)
   /(pow((b.wind_speed_120m-b.wind_speed_80m)/40.0e0, 2)+1e-6))) AS ri
  FROM base b LEFT JOIN reanalysis_v2 v USING (site_id, ts) LEFT JOIN merra n USING (site_id, ts))""")
W120 = "wind_speed_120m"


def _v2_frame(spark, sf):
    b = weather.extra_columns(weather.rotor_columns(base(spark, sf)))
    b = b.withColumns({"ws_shear_10_80": F.col("wind_speed_80m") - F.col("wind_speed_10m")})
    return with_feed(spark, sf, b, "era5v2", "nasa")


def _v2_query(name: str, op, doubles: dict[str, str], ints: dict[str, str] | None = None) -> None:
    @query(name, _V2 + "SELECT " + cols(doubles, ints) + " FROM x")
    def _(spark, sf, op=op):
        b = _v2_frame(spark, sf)
        return added(b, op(b))


_v2_query("P24_boundary_layer", reanalysis.boundary_layer_columns, {
    "blh_hub_ratio": clip("blh/85.0e0", None, "50.0e0"), "blh_minus_hub": clip("blh-85.0e0", "0.0e0", "3000.0e0"), "blh_log": "ln(1+blh)",
    "blh_x_ws120": f"blh*{W120}", "blh_x_shear": "blh*sh80_180", "blh_time_of_day": "blh*is_daytime",
    "blh_stability_coupled": "blh*ri", "cbh_vs_blh": clip("cbh-blh", "-2000.0e0", "2000.0e0")})
_v2_query("P25_heat_flux", reanalysis.heat_flux_columns, {
    "heat_flux_total": "sshf+slhf", "bowen_ratio": "sshf/(abs(slhf)+1)", "heat_flux_x_ws120": f"sshf*{W120}", "sshf_x_rews": "sshf*rews",
    "sshf_norm": f"sshf/({W120}+1)", "slhf_norm": f"slhf/({W120}+1)"}, {"flux_stability_flag": _b("sshf > 0")})
_v2_query("P26_soil", reanalysis.soil_columns, {
    "stl_deep_gradient": "stl1-stl4", "stl1_x_ws120": f"stl1*{W120}", "stl1_vs_t120m": "stl1-temperature_120m-273.15e0",
    "soil_moisture_x_ws": f"swvl1*{W120}", "snow_x_stl": "snowc*stl1", "soil_wetness_ratio": "swvl1/(swvl2+0.01e0)"})
_v2_query("P27_humidity", reanalysis.humidity_columns, {
    "rh_x_ws120": f"rh2m*{W120}/100.0e0", "rh_x_density": "rh2m*air_density/100.0e0", "rh_x_temp": "rh2m*temperature_120m/100.0e0",
    "rh_x_precip": "rh2m*(rain+showers)/100.0e0", "slp_vs_msl": "(slp-ps)/100.0e0"})


def _wrap(a: str) -> str:
    return f"degrees(atan2(sin(radians({a})), cos(radians({a}))))"


_v2_query("P28_upper_wind", reanalysis.upper_wind_columns, {
    "ws180_vs_ws120_ratio": f"wind_speed_180m/({W120}+0.1e0)", "ws180_cube": "pow(wind_speed_180m,3)",
    "ws_shear_120_180": f"(wind_speed_180m-{W120})/greatest({W120}, 0.1e0)",
    "veer_120_180": _wrap("(wind_direction_180m-wind_direction_120m)*1000.0e0"), "veer_total": _wrap("(wind_direction_180m-wind_direction_10m)*1000.0e0"),
    "ws925_vs_ws120": f"wind_speed_925hpa/({W120}+0.1e0)", "ws84_vs_ws120": f"wind_speed_84m/({W120}+0.1e0)", "ws84_era5_cube": "pow(wind_speed_84m,3)"})
_v2_query("P29_convection", reanalysis.convection_columns, {
    "cape_x_ws_cube": f"CASE WHEN cape IS NOT NULL THEN sqrt(greatest(cape, 0.0e0)) END*pow({W120},3)", "precip_convective_ratio": "cp/(cp+lsp+1e-6)", "total_precip_era5": "cp+lsp",
    "precip_x_wind": f"(cp+lsp)*{W120}", "tcwv_x_t": "tcwv*temperature_120m", "cape_flag_x_ws": f"is_llj*{W120}"})
_v2_query("P30_roughness", reanalysis.roughness_columns, {
    "z0m_log": "ln(1+z0m)", "z0m_x_ws120_cube": f"z0m*pow({W120},3)", "effective_hub_height": clip("85-disph", "10.0e0", "85.0e0"),
    "disph_x_shear": "disph*sh10_80", "z0m_x_alpha": "z0m*alpha_10_100"})
_v2_query("P31_upper_air", reanalysis.upper_air_interactions, {
    "era5v2_ws120_vs_nwp120": f"v120-{W120}", "era5v2_ws120_vs_nwp120_sq": f"pow(v120-{W120}, 2)", "era5v2_ws84_vs_nwp80": "wind_speed_84m-wind_speed_80m",
    "era5v2_ws120m_cube": "pow(v120,3)", "era5v2_ws120m_cube_x_active": "pow(v120,3)*active_turbines_ratio", "era5v2_llj_x_ws120": f"llj_strength*{W120}",
    "era5v2_llj_x_rews": "llj_strength*rews", "era5v2_blh_log": "ln(1+blh)", "era5v2_blh_x_ws120": f"blh*{W120}/1000.0e0",
    "era5v2_blh_over_shear": "blh/1000.0e0/greatest(abs(sh10_80), 0.01e0)", "era5v2_cape_sqrt": "CASE WHEN cape IS NOT NULL THEN sqrt(greatest(cape,0.0e0)) END",
    "era5v2_cape_x_ws120": f"CASE WHEN cape IS NOT NULL THEN greatest(cape,0.0e0) END*{W120}", "era5v2_850hpa_x_ws120": f"wind_speed_850hpa*{W120}",
    "era5v2_925hpa_x_ws120": f"wind_speed_925hpa*{W120}", "era5v2_925_850_shear": "wind_speed_925hpa-wind_speed_850hpa", "era5v2_tcwv_norm": "tcwv/30.0e0",
    "era5v2_snow_x_ws120": f"snowc*{W120}", "era5v2_skt_t2m_x_ws120": f"skt_minus_t2m*{W120}"},
    {"era5v2_llj_flag": _b("llj_strength > 1"), "era5v2_shallow_bl_flag": _b("blh < 200"), "era5v2_cape_flag": _b("cape > 100")})


def _cosd(a: str, b: str) -> str:
    return f"cos(radians({a}-{b}))"


@query("P32_direction_agreement", with_(HOURLY, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("reanalysis"), """x AS (SELECT h.site_id, h.ts,
   g.wind_direction_100m AS g, c.wind_direction_100m AS c, e.wind_direction_100m AS e FROM hourly h
   LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    "gfs_era5_dir_agree": _cosd("g", "e"), "ecmwf_era5_dir_agree": _cosd("c", "e"), "gfs_ecmwf_dir_agree": _cosd("g", "c"),
    "multi_dir_consensus": f"({_cosd('g', 'e')}+{_cosd('c', 'e')})/2.0e0"},
    {"multi_dir_uncertain_flag": _b(f"({_cosd('g', 'e')}+{_cosd('c', 'e')})/2.0e0 < 0.7e0")}) + " FROM x")
def direction_agreement(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "gfs", "ecmwf", "era5")
    h = h.withColumns({f"{n}_{k}": f(F.radians(d)) for n, d in (("gfs_dir100m", "gfs_dir100m"), ("ecmwf_dir100m", "ecmwf_dir100m"),
                       ("era5_dir100", "era5_wind_direction_100m")) for k, f in (("sin", F.sin), ("cos", F.cos))})
    return added(h, reanalysis.direction_agreement_columns(h))


@query("P33_stability", _V2 + ", y AS (SELECT *, temperature_120m-temperature_80m AS tg, least(0.7e0, greatest(-0.3e0, ln(least(10.0e0, greatest(0.1e0,"
    " greatest(wind_speed_120m,0.1e0)/greatest(wind_speed_10m,0.1e0))))/ln(12.0e0))) AS al FROM x) SELECT " + cols({
    "stability_x_ws120": f"tg*{W120}", "stability_x_rews": "tg*rews", "ri_x_ws120": f"ri*{W120}", "hellmann_x_ws120": f"al*{W120}"},
    {"is_inversion": _b("tg > 0"), "stable_highwind_flag": _b(f"ri > 0.25 AND {W120} > 8"), "high_shear_flag": _b("al > 0.3")}) + " FROM y")
def stability(spark, sf):
    b = weather.extra_columns(weather.rotor_columns(weather.shear_exponent_column(weather.atmosphere_columns(base(spark, sf)))))
    return added(b, reanalysis.stability_interactions(b))


@query("P34_source_power_density", with_(BASE, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("reanalysis"), feed_cte("reanalysis_v2"), f"""x AS (SELECT b.*,
   {rho('g.pressure_msl', 'g.temperature_2m')} AS gr, g.wind_speed_100m AS gw, {rho('c.pressure_msl', 'c.temperature_2m')} AS cr, c.wind_speed_100m AS cw,
   e.wind_speed_100m AS ew, v.air_density AS vr, v.wind_speed_120m AS vw FROM base b LEFT JOIN gfs g USING (site_id, ts)
   LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts) LEFT JOIN reanalysis_v2 v USING (site_id, ts))""",
   """y AS (SELECT *, 0.5e0*gr*pow(gw,3) AS gp, 0.5e0*cr*pow(cw,3) AS cp, 0.5e0*air_density*pow(wind_speed_120m,3) AS bp FROM x)""") + "SELECT " + cols({
    "gfs_air_density": "gr", "gfs_v_eff": "gw*cbrt(gr/1.225e0)", "gfs_wpd": "gp", "gfs_v_eff_cube": "pow(gw,3)*gr/1.225e0",
    "ecmwf_air_density": "cr", "ecmwf_v_eff": "cw*cbrt(cr/1.225e0)", "ecmwf_wpd": "cp", "ecmwf_v_eff_cube": "pow(cw,3)*cr/1.225e0",
    "gfs_wpd_vs_era5_wpd": "gp-0.5e0*air_density*pow(ew,3)", "wpd_ens_mean": "list_avg([bp,gp,cp])", "wpd_ens_std": "list_stddev_pop([bp,gp,cp])",
    "wpd_ens_range": "greatest(bp,gp,cp)-least(bp,gp,cp)", "era5v2_v_eff_120m": "vw*cbrt(vr/1.225e0)", "era5v2_v_eff_120m_cube": "pow(vw,3)*vr/1.225e0",
    "era5v2_wpd_120m": "0.5e0*vr*pow(vw,3)", "era5v2_v_eff_120m_cube_x_active": "pow(vw,3)*vr/1.225e0*active_turbines_ratio"}) + " FROM y")
def source_power_density(spark, sf):
    b = weather.density_wind_columns(base(spark, sf)).drop("v_eff_cube")
    b = with_feed(spark, sf, b, "gfs", "ecmwf", "era5", "era5v2")
    return added(b, reanalysis.source_power_density_columns(b))


@query("P35_regimes", _V2 + f""", y AS (SELECT *, least(1.0e0, greatest(0.0e0, ({W120}-7)/3.0e0))*(1-least(1.0e0, greatest(0.0e0, ({W120}-10)/2.0e0))) AS st,
   least(0.7e0, greatest(-0.3e0, ln(least(10.0e0, greatest(0.1e0, greatest(wind_speed_120m,0.1e0)/greatest(wind_speed_10m,0.1e0))))/ln(12.0e0))) AS al,
   CASE WHEN hour(ts) >= 20 OR hour(ts) <= 3 THEN 1 ELSE 0 END AS nt FROM x) SELECT """ + cols({
    "regime_sub_cutin": f"1-least(1.0e0, greatest(0.0e0, {W120}/3.0e0))", "regime_steep": "st", "regime_rated": f"least(1.0e0, greatest(0.0e0, ({W120}-12)/2.0e0))",
    "alpha_x_steep": "al*st", "ri_x_steep": "ri*st", "night_density": "nt*air_density", "night_x_ws120": f"nt*{W120}"},
    {"regime_steep_flag": _b(f"{W120} >= 7 AND {W120} < 10"), "regime_rated_flag": _b(f"{W120} >= 12"), "is_night": "nt"}) + " FROM y")
def regimes(spark, sf):
    b = weather.extra_columns(weather.shear_exponent_column(base(spark, sf)))
    return added(b, weather.regime_columns(b))


@query("P36_steep_zone", with_(HOURLY, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("reanalysis"), """x AS (SELECT h.*,
   g.wind_speed_100m AS g, c.wind_speed_100m AS c, list_avg([e.wind_speed_100m, g.wind_speed_100m, c.wind_speed_100m]) AS mu,
   list_stddev_pop([e.wind_speed_100m, g.wind_speed_100m, c.wind_speed_100m]) AS sd,
   CASE WHEN h.wind_speed_120m BETWEEN 7 AND 10 THEN 1 ELSE 0 END AS st FROM hourly h
   LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    "jensen_correction": "3*pow(sd/greatest(wind_speed_120m, 0.5e0), 2)", "steep_x_jensen": "st*3*pow(sd/greatest(wind_speed_120m, 0.5e0), 2)",
    "wind_cv": "sd/greatest(mu, 0.1e0)", "steep_x_wind_cv": "st*sd/greatest(mu, 0.1e0)", "cube_gfs_ecmwf_diff": "abs(pow(g,3)-pow(c,3))",
    "steep_x_cube_diff": "st*abs(pow(g,3)-pow(c,3))", "steep_x_gfs_ecmwf_dir_diff": "st*abs(g-c)"}, {"steep_zone_flag": "st"}) + " FROM x")
def steep_zone(spark, sf):
    from galeframe.functions.physics import cube
    from galeframe.functions.rowstats import row_mean, row_std
    h = with_feed(spark, sf, hourly(spark, sf), "gfs", "ecmwf", "era5")
    three = ["era5_wind_speed_100m", "gfs_ws100m", "ecmwf_ws100m"]
    h = h.withColumns({"ens3_ws100_mean": row_mean(three), "ens3_ws100_std": row_std(three), "gfs_ws100m_cube": cube("gfs_ws100m"),
                       "ecmwf_ws100m_cube": cube("ecmwf_ws100m"), "gfs_ecmwf_dir_diff": F.abs(F.col("gfs_ws100m") - F.col("ecmwf_ws100m"))})
    return added(h, weather.steep_zone_columns(h))


@query("P37_ai_forecast", with_(BASE, feed_cte("ai"), feed_cte("reanalysis"), """j AS (SELECT b.*, a.* EXCLUDE (site_id, ts), e.wind_speed_100m AS e100
   FROM base b LEFT JOIN ai a USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""",
   curve_ctes("j", "x", {"ka": ("aifs_wind_speed_100m", "air_density")})) + "SELECT " + cols({
    "aifs_v_eff_100m": "aifs_wind_speed_100m*cbrt(air_density/1.225e0)", "aifs_ds_farm_mw": _mw("ka"), "aifs_vs_era5_ws100m": "aifs_wind_speed_100m-e100",
    **_sc("aifs_dir100m", "radians(aifs_wind_direction_100m)"), "graphcast_ws100m_extrap": "graphcast_wind_speed_10m*pow(10.0e0, 1.0e0/7.0e0)",
    "graphcast_vs_era5_ws10m": "graphcast_wind_speed_10m-wind_speed_10m", **_sc("graphcast_dir10m", "radians(graphcast_wind_direction_10m)")}) + " FROM x")
def ai_forecast(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "era5").join(feed(spark, sf, "ai"), [SITE, TS], "left")
    return added(b, reanalysis.ai_forecast_columns(b))


@query("P38_capacity_factor", with_(BASE, "x AS (SELECT *, power_mw/(active_turbines*3.465e0) AS cf FROM base)") + "SELECT " + cols({
    "cf": "cf", "cf_mw": "least(1.0e0, greatest(0.0e0, cf))*active_turbines*3.465e0"}) + " FROM x")
def capacity_factor(spark, sf):
    b = base(spark, sf)
    return added(b, weather.from_capacity_factor(weather.to_capacity_factor(b)))


@query("P39_logit", with_(BASE, "x AS (SELECT *, least(0.999e0, greatest(0.001e0, power_mw/(active_turbines*3.465e0))) AS p FROM base)") + "SELECT " + cols({
    "cf_logit": "ln(p/(1-p))", "cf_from_logit": "p"}) + " FROM x")
def logit(spark, sf):
    b = weather.to_capacity_factor(base(spark, sf))
    return added(b, weather.logit_columns(b))


@query("P40_feature_names", with_(BASE) + """SELECT column_name AS feature, CAST(count AS BIGINT) AS n_present FROM (
  UNPIVOT (SELECT count(COLUMNS(* EXCLUDE (ts, power_mw))) FROM base) ON COLUMNS(*) INTO NAME column_name VALUE count)""")
def feature_names(spark, sf):
    b = base(spark, sf)
    names = weather.numeric_feature_names(b)
    wide = b.agg(*[F.count(n).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return wide.select(F.expr(f"stack({len(names)}, {pairs}) AS (feature, n_present)"))


