"""Queries over the enrichment joins and cross-source statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TS
from galeframe.operators import ensemble, joins
from galeframe.plans.frames import added, base, with_feed
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, cols, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.sources.derived import feed, hourly, oof


def z(e: str) -> str:
    return f"coalesce({e}, 0)"


def sc(prefix: str, deg: str, fill: bool = True) -> dict[str, str]:
    f = z if fill else (lambda e: e)
    return {f"{prefix}_sin": f(f"sin(radians({deg}))"), f"{prefix}_cos": f(f"cos(radians({deg}))")}


def lag_diff(e: str, n: int) -> str:
    return f"{e}-lag({e}, {n}) OVER (PARTITION BY site_id ORDER BY ts)"


def mx(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0.1e0) END)"


_BE = with_(BASE, feed_cte("reanalysis"), "j AS (SELECT b.*, e.* EXCLUDE (site_id, ts) RENAME (wind_speed_10m AS e10, wind_speed_100m AS e100, "
    "wind_direction_10m AS ed10, wind_direction_100m AS ed100, wind_gusts_10m AS eg, temperature_2m AS et, pressure_msl AS ep, cloud_cover_low AS ec, rain AS er, snowfall AS es) "
    "FROM base b LEFT JOIN reanalysis e USING (site_id, ts))")
_ERA_NAMES = {"era5_wind_speed_10m": "e10", "era5_wind_speed_100m": "e100", "era5_wind_direction_10m": "ed10", "era5_wind_direction_100m": "ed100",
              "era5_wind_gusts_10m": "eg", "era5_temperature_2m": "et", "era5_pressure_msl": "ep", "era5_cloud_cover_low": "ec", "era5_rain": "er", "era5_snowfall": "es"}


@query("J01_reanalysis", _BE + "SELECT " + cols({**{k: z(v) for k, v in _ERA_NAMES.items()},
    "ws10_bias": z("wind_speed_10m-e10"), "ws100_vs_80": z("e100-wind_speed_80m"), "gust_bias": z("wind_gusts_10m-eg"), "pressure_bias": z("pressure_msl-ep"),
    "era5_ws100_cube": z("pow(e100,3)"), "era5_ws100_x_active": z("pow(e100,3)*active_turbines_ratio"), **sc("era5_dir100", "ed100")}) + " FROM j")
def reanalysis(spark, sf):
    b = base(spark, sf)
    return added(b, joins.join_reanalysis(b, feed(spark, sf, "reanalysis")))


_V2COLS = ("blh", "cbh", "wind_speed_850hpa", "wind_speed_925hpa", "llj_strength", "is_llj", "cape", "tcwv", "sshf", "slhf", "cp", "lsp", "stl1", "stl4",
           "swvl1", "swvl2", "snowc", "skt_minus_t2m", "air_density", "alpha_10_100", "wind_speed_84m", "wind_speed_120m", "is_daytime")


@query("J02_second_reanalysis", with_(HOURLY, feed_cte("reanalysis_v2")) + "SELECT " + cols({f"era5v2_{n}": z(f"v.{n}") for n in _V2COLS})
       + " FROM hourly h LEFT JOIN reanalysis_v2 v USING (site_id, ts)")
def second_reanalysis(spark, sf):
    h = hourly(spark, sf)
    return added(h, joins.join_second_reanalysis(h, feed(spark, sf, "reanalysis_v2")))


def om(stem: str) -> str:
    return "[" + ", ".join(f"om_{stem}_{m}" for m in ("ecmwf_ifs025", "gfs_global", "icon_global", "best_match")) + "]"


def om_trig(f: str) -> str:
    return "[" + ", ".join(f"{f}(radians(om_wind_direction_100m_{m}))" for m in ("ecmwf_ifs025", "gfs_global", "icon_global", "best_match")) + "]"


@query("J03_multi_source", with_(HOURLY, feed_cte("multi"), f"""s AS (SELECT site_id, ts, list_avg({om('wind_speed_100m')}) AS mu, list_median({om('wind_speed_100m')}) AS md,
   list_stddev_samp({om('wind_speed_100m')}) AS sd, list_max({om('wind_speed_100m')})-list_min({om('wind_speed_100m')}) AS rg, list_avg({om('wind_speed_10m')}) AS m10,
   list_avg({om('wind_gusts_10m')}) AS g, list_avg({om_trig('sin')}) AS ds, list_avg({om_trig('cos')}) AS dc FROM multi)""") + "SELECT " + cols({
    "om_ens_ws100_mean": z("mu"), "om_ens_ws100_median": z("md"), "om_ens_ws100_std": z("sd"), "om_ens_ws100_range": z("rg"),
    "om_ens_ws100_84m": z("mu*pow(0.84e0, 0.14e0)"), "om_ens_ws10_mean": z("m10"), "om_ens_gust_mean": z("g"), "om_ens_dir_sin": z("ds"), "om_ens_dir_cos": z("dc"),
    "om_ens_nwp_diff": z("wind_speed_120m*pow(100.0e0/120.0e0, 0.14e0)-mu")}) + " FROM hourly LEFT JOIN s USING (site_id, ts)")
def multi_source(spark, sf):
    h = hourly(spark, sf)
    return added(h, joins.join_multi_source(h, feed(spark, sf, "multi")))


_ICON = with_(HOURLY, feed_cte("icon"), feed_cte("reanalysis"), """j AS (SELECT h.*, i.wind_speed_100m AS i100, i.wind_direction_100m AS idir, i.wind_speed_10m AS i10,
   i.wind_gusts_10m AS ig, i.temperature_2m AS it, i.pressure_msl AS im, e.wind_speed_100m AS e100
   FROM hourly h LEFT JOIN icon i USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""")


def _icon(spark, sf, impute):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, joins.join_regional_model(h, feed(spark, sf, "icon"), impute=impute))


@query("J04_regional_model", _ICON + "SELECT " + cols({"icon_ws100m": "i100", "icon_dir100m": "idir", "icon_ws10m": "i10", "icon_gusts10m": "ig", "icon_t2m": "it",
    "icon_msl": "im", **sc("icon_dir100m", "idir", False), "icon_delta_ws100m": "i100-e100", "icon_ratio_ws100m": f"i100/{mx('e100')}",
    "nwp_spread_ws100m": "list_stddev_pop([e100, i100])"}) + " FROM j")
def regional_model(spark, sf):
    return _icon(spark, sf, False)


def _alt(x: str, y: str) -> str:
    return f"CASE WHEN i100 IS NULL THEN {y} ELSE {x} END"


@query("J04_regional_model_imputed", _ICON + ", k AS (SELECT *, coalesce(i100, e100) AS f100 FROM j) SELECT " + cols({
    "icon_ws100m": "f100", "icon_dir100m": _alt("idir", "0"), "icon_ws10m": _alt("i10", "wind_speed_10m"),
    **{n: _alt(x, f"(SELECT median({x}) FROM j)") for n, x in (("icon_gusts10m", "ig"), ("icon_t2m", "it"), ("icon_msl", "im"))},
    "icon_dir100m_sin": _alt("sin(radians(idir))", "0"), "icon_dir100m_cos": _alt("cos(radians(idir))", "0"), "icon_delta_ws100m": "f100-e100",
    "icon_ratio_ws100m": f"f100/{mx('e100')}", "nwp_spread_ws100m": z("list_stddev_pop([e100, f100])")}) + " FROM k")
def regional_model_imputed(spark, sf):
    return _icon(spark, sf, True)


@query("J05_best_match", with_(HOURLY, feed_cte("multi"), feed_cte("reanalysis"), """j AS (SELECT h.*, o.om_wind_speed_100m_best_match AS bm, o.om_wind_speed_100m_gfs_global AS g,
   o.om_wind_std AS s, o.om_wind_range AS r, o.om_wind_hub_mean AS u, e.wind_speed_100m AS e FROM hourly h LEFT JOIN multi o USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""")
    + "SELECT " + cols({"om_bm_ws100": z("bm"), "om_gfs_ws100": z("g"), "om_wind_std_v2": z("s"), "om_wind_range_v2": z("r"), "om_wind_hub_v2": z("u"),
    "om_bm_gfs_diff": z("bm-g"), "om_bm_delta": z("bm-e"), "om_gfs_delta": z("g-e"), "om_bm_ratio": z(f"bm/{mx('e')}")}) + " FROM j")
def best_match(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, joins.join_best_match(h, feed(spark, sf, "multi")))


_OWN = "wind_speed_120m*pow(100.0e0/120.0e0, 0.14e0)"
_GL = with_(HOURLY, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("reanalysis"), """j AS (SELECT h.*, g.wind_speed_100m AS g100, g.wind_speed_10m AS g10, g.wind_direction_100m AS gd,
   g.wind_direction_10m AS gd10, g.wind_gusts_10m AS gg, g.temperature_2m AS gt, g.pressure_msl AS gp, c.wind_speed_100m AS c100, c.wind_speed_10m AS c10, c.wind_direction_100m AS cd,
   c.wind_gusts_10m AS cg, c.temperature_2m AS ct, c.pressure_msl AS cp, e.wind_speed_100m AS e100
   FROM hourly h LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""")


@query("J06_global_model_a", _GL + "SELECT " + cols({"gfs_ws10m": z("g10"), "gfs_ws100m": z("g100"), "gfs_dir10m": z("gd10"), "gfs_dir100m": z("gd"), "gfs_gust10m": z("gg"),
    "gfs_t2m": z("gt"), "gfs_msl": z("gp"), **sc("gfs_dir100m", "gd"), "gfs_ws100m_cube": z("pow(g100,3)"), "gfs_vs_era5_100": z("g100-e100"),
    "gfs_ratio_era5_100": z(f"g100/{mx('e100')}"), "gfs_vs_nwp_100": z(f"g100-{_OWN}"), "gfs_ws100m_trend_6h": z(lag_diff("g100", 6)),
    "gfs_ws100m_trend_12h": z(lag_diff("g100", 12))}) + " FROM j")
def global_model_a(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, joins.join_global_model_a(h, feed(spark, sf, "gfs")))


@query("J07_global_model_b", _GL + "SELECT " + cols({"ecmwf_ws10m": z("c10"), "ecmwf_ws100m": z("c100"), "ecmwf_dir100m": z("cd"), "ecmwf_gust10m": z("cg"),
    "ecmwf_t2m": z("ct"), "ecmwf_msl": z("cp"), **sc("ecmwf_dir100m", "cd"), "ecmwf_ws100m_cube": z("pow(c100,3)"), "ecmwf_vs_era5_100": z("c100-e100"),
    "ecmwf_ratio_era5_100": z(f"c100/{mx('e100')}"), "ecmwf_vs_nwp_100": z(f"c100-{_OWN}"), "gfs_vs_ecmwf_100": z("coalesce(g100,0)-c100"),
    "ecmwf_gfs_mean": z("(coalesce(g100,0)+c100)/2"), "ecmwf_ws100m_trend_6h": z(lag_diff("c100", 6)), "ecmwf_ws100m_trend_12h": z(lag_diff("c100", 12))}) + " FROM j")
def global_model_b(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    h = joins.join_global_model_a(h, feed(spark, sf, "gfs"), trends=False)
    return added(h, joins.join_global_model_b(h, feed(spark, sf, "ecmwf")))


@query("J08_last_by_key", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6)+0.0e0 AS value,
  CAST(arg_max(ts, event_id) AS VARCHAR) AS ts FROM events GROUP BY user_id""")
def last_by_key(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts")
    return joins.last_by_key(e, order="event_id", keys=["user_id"])


@query("J09_independent_reanalysis", with_(HOURLY, feed_cte("merra"), feed_cte("reanalysis"), """j AS (SELECT h.*, n.* EXCLUDE (site_id, ts), e.wind_speed_100m AS e100, e.wind_speed_10m AS e10,
   e.temperature_2m AS et FROM hourly h LEFT JOIN merra n USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    **{f"nasa_{n}": z(n) for n in ("ws50m", "ws10m", "wd50m", "wd10m", "t2m", "rh2m", "slp", "ps", "z0m", "disph")}, "nasa_prectot": z("prectotcorr"),
    "nasa_allsky_sw": z("allsky_sfc_sw_dwn"), **sc("nasa_wd10m", "wd10m"), **sc("nasa_wd50m", "wd50m"), "nasa_ws50m_cube": z("pow(ws50m,3)"), "nasa_shear_10_50": z("ws50m-ws10m"),
    "nasa_roughness_x_ws50": z("z0m*ws50m"), "nasa_disph_x_ws50": z("disph*ws50m"), "nasa_ws50_vs_era5_100": z("ws50m-e100"),
    "nwp_spread_nasa_era5": z("list_stddev_pop([e100, ws50m])"), "nasa_ws10_vs_era5_10": z("ws10m-e10"), "nasa_t2m_vs_era5": z("t2m-et")}) + " FROM j")
def independent_reanalysis(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, joins.join_independent_reanalysis(h, feed(spark, sf, "merra")))


_UP = "pow(10.0e0, 0.2e0)"


@query("J10_surface_models", with_(HOURLY, feed_cte("gem"), feed_cte("icon_global"), feed_cte("gfs"), feed_cte("reanalysis"), """j AS (SELECT h.*, a.wind_speed_10m AS a, a.wind_gusts_10m AS ag,
   b.wind_speed_10m AS b, g.wind_speed_10m AS g10, g.wind_speed_100m AS g100, e.wind_speed_100m AS e100 FROM hourly h LEFT JOIN gem a USING (site_id, ts) LEFT JOIN icon_global b USING (site_id, ts)
   LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    "gem_ws10m": "a", "icong_ws10m": "b", "gem_ws100_extrap": f"a*{_UP}", "icong_ws100_extrap": f"b*{_UP}", "gem_ws100_extrap_cube": f"pow(a*{_UP},3)",
    "gem_ws10_vs_era5": "a-wind_speed_10m", "icong_ws10_vs_era5": "b-wind_speed_10m", "gem_vs_era5_100m_bias": f"a*{_UP}-e100", "icong_vs_era5_100m_bias": f"b*{_UP}-e100",
    "gem_gust_vs_era5": "ag-wind_gusts_10m", "surface_model_spread_10m": "list_stddev_pop([wind_speed_10m, g10, a, b])",
    "surface_model_spread_100m": f"list_stddev_pop([e100, g100, a*{_UP}, b*{_UP}])"}) + " FROM j")
def surface_models(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5", "gfs")
    return added(h, joins.join_surface_models(h, feed(spark, sf, "gem"), feed(spark, sf, "icon_global"), ref_100m="era5_wind_speed_100m"))


AI_COLUMNS = ("aifs_wind_speed_100m", "aifs_wind_direction_100m", "graphcast_wind_speed_10m", "graphcast_wind_direction_10m", "graphcast_pressure_msl")


@query("J11_ai_forecast", with_(HOURLY, feed_cte("ai"), feed_cte("reanalysis"), """j AS (SELECT h.*, a.* EXCLUDE (site_id, ts), e.wind_speed_100m AS e100
   FROM hourly h LEFT JOIN ai a USING (site_id, ts) LEFT JOIN reanalysis e USING (site_id, ts))""") + "SELECT " + cols({
    **{n: n for n in AI_COLUMNS},
    "gc_ws10_bias": "wind_speed_10m-graphcast_wind_speed_10m", "gc_pressure_bias": "pressure_msl-graphcast_pressure_msl", "aifs_ws100_vs_80": "aifs_wind_speed_100m-wind_speed_80m",
    "aifs_ws100_cube": "pow(aifs_wind_speed_100m,3)", "era5_aifs_ws_diff": "e100-aifs_wind_speed_100m", "aifs_dir100_sin": "sin(radians(coalesce(aifs_wind_direction_100m,0)))",
    "aifs_dir100_cos": "cos(radians(coalesce(aifs_wind_direction_100m,0)))"}) + " FROM j")
def ai_forecast(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, joins.join_ai_forecast(h, feed(spark, sf, "ai"), keep=AI_COLUMNS))


@query("J12_coverage", with_(HOURLY, feed_cte("gfs")) + "SELECT " + cols({"matched_share": "avg(CASE WHEN g.wind_speed_100m IS NULL THEN 0 ELSE 1 END)"},
    {"n_rows": "count(*)", "n_matched": "count(g.wind_speed_100m)"}, keys="") + " FROM hourly h LEFT JOIN gfs g USING (site_id, ts)")
def coverage(spark, sf):
    return joins.coverage(hourly(spark, sf), feed(spark, sf, "gfs"))


@query("J13_align_predictions", with_(OOF, feed_cte("gfs")) + "SELECT " + cols({"target_mw": "target_mw", "a_pred_cf_mw": "pred_cf_mw", "b_pred_mw_mw": "pred_mw_mw"}, {"fold": "fold"})
       + " FROM oof JOIN gfs USING (site_id, ts)")
def align(spark, sf):
    o = oof(spark, sf)
    a = o.select("fold", SITE, TS, "target_mw", "pred_cf_mw")
    b = o.join(feed(spark, sf, "gfs").select(SITE, TS), [SITE, TS], "left_semi").select("fold", SITE, TS, "pred_mw_mw")
    return joins.align_predictions({"a": a, "b": b})


@query("J14_outer_merge", with_(feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("icon")) + "SELECT " + cols({
    "gfs_wind_speed_100m": "g.wind_speed_100m", "ecmwf_wind_speed_100m": "c.wind_speed_100m", "icon_wind_speed_100m": "i.wind_speed_100m"})
    + " FROM gfs g FULL JOIN ecmwf c USING (site_id, ts) FULL JOIN icon i USING (site_id, ts)")
def outer_merge(spark, sf):
    return joins.outer_merge({n: feed(spark, sf, n).select(SITE, TS, "wind_speed_100m") for n in ("gfs", "ecmwf", "icon")})


@query("J15_stitch", with_(OOF) + "SELECT " + cols({"pred_mw_mw": "pred_mw_mw", "stitched_mw":
    "CASE WHEN ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-23' THEN 0.7e0*pred_cf_mw+0.3e0*pred_mw_mw ELSE pred_mw_mw END"}) + " FROM oof")
def stitch(spark, sf):
    o = oof(spark, sf)
    other = o.select(SITE, TS, F.col("pred_cf_mw").alias("other_mw"))
    return joins.stitch_forecast(o.select(SITE, TS, "pred_mw_mw"), other, start="2024-01-21 00:00:00", hours=48, alpha=0.7, base_col="pred_mw_mw")


@query("J16_fallback_fill", _BE + "SELECT " + cols({
    "era5_wind_speed_10m": "coalesce(e10, wind_speed_10m)", "era5_wind_speed_100m": "coalesce(e100, wind_speed_80m)", "era5_wind_direction_10m": "coalesce(ed10, wind_direction_10m*1000)",
    "era5_wind_direction_100m": "coalesce(ed100, wind_direction_80m*1000)", "era5_wind_gusts_10m": "coalesce(eg, wind_gusts_10m)", "era5_temperature_2m": "coalesce(et, temperature_80m)",
    "era5_pressure_msl": "coalesce(ep, pressure_msl)", "era5_cloud_cover_low": "coalesce(ec, cloud_cover_low*100)", "era5_rain": "coalesce(er, rain)", "era5_snowfall": "coalesce(es, snowfall)",
    "ws10_bias": "coalesce(wind_speed_10m-e10, 0)", "era5_ws100_cube": "pow(coalesce(e100, wind_speed_80m), 3)", "era5_ws100_x_active": "pow(coalesce(e100, wind_speed_80m), 3)*active_turbines_ratio",
    **sc("era5_dir100", "coalesce(ed100, wind_direction_80m*1000)")}) + " FROM j")
def fallback_fill(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "era5").withColumns({"ws10_bias": F.col("wind_speed_10m") - F.col("era5_wind_speed_10m")})
    out = joins.fill_reanalysis_from_forecast(b)
    return out.select(SITE, TS, *[n for n in out.columns if n.startswith("era5_")], "ws10_bias")


_FOLDS = (("f1", "2024-01-10 23:00:00", "2024-01-11 00:00:00", "2024-01-15 23:00:00"), ("f2", "2024-01-20 23:00:00", "2024-01-21 00:00:00", "2024-01-30 23:00:00"))


@query("J18_folds", with_(HOURLY, "f(fold_name, te, vs, ve) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{d}')" for n, a, b, d in _FOLDS) + ")")
    + """SELECT site_id, CAST(ts AS VARCHAR) AS ts, fold_name, CASE WHEN ts BETWEEN vs AND ve THEN 'val' ELSE 'train' END AS role
    FROM hourly JOIN f ON ts <= te AND ts <= vs - INTERVAL 24 HOUR OR ts BETWEEN vs AND ve""")
def folds(spark, sf):
    return joins.assign_folds(hourly(spark, sf).select(SITE, TS), _FOLDS, embargo_hours=24)


_FIVE = "[e100, g100, c100, i100]"
_ALL = with_(HOURLY, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("icon"), feed_cte("reanalysis"), feed_cte("merra"), f"""j AS (SELECT h.*, g.wind_speed_100m AS g100, g.wind_speed_10m AS g10,
   g.wind_gusts_10m AS gg, g.wind_direction_100m AS gd, c.wind_speed_100m AS c100, c.wind_speed_10m AS c10, c.wind_gusts_10m AS cg, c.wind_direction_100m AS cd,
   i.wind_speed_100m AS i100, i.wind_speed_10m AS i10, i.wind_gusts_10m AS ig, i.wind_direction_100m AS idir,
   e.wind_speed_100m AS e100, e.wind_speed_10m AS e10, e.wind_gusts_10m AS eg, n.ws50m AS n50, {_OWN} AS own
   FROM hourly h LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN icon i USING (site_id, ts)
   LEFT JOIN reanalysis e USING (site_id, ts) LEFT JOIN merra n USING (site_id, ts))""")


@query("E01_row_statistics", _ALL + "SELECT " + cols({"src_mean": f"list_avg({_FIVE})", "src_median": f"list_median({_FIVE})", "src_std": f"list_stddev_pop({_FIVE})",
    "src_min": f"list_min({_FIVE})", "src_max": f"list_max({_FIVE})", "src_range": f"list_max({_FIVE})-list_min({_FIVE})"}) + " FROM j")
def row_statistics(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5", "gfs", "ecmwf", "icon")
    return added(h, ensemble.row_statistics(h, ["era5_wind_speed_100m", "gfs_ws100m", "ecmwf_ws100m", "icon_ws100m"], prefix="src"))


_T3 = "[e100, g100, c100]"


@query("E02_consensus", _ALL + f", k AS (SELECT *, list_avg({_T3}) AS mu, list_stddev_pop({_T3}) AS sd, list_avg({_FIVE}) AS mu4, list_stddev_pop({_FIVE}) AS sd4 FROM j) SELECT " + cols({
    "ens3_ws100_mean": z("mu"), "ens3_ws100_std": z("sd"), "ens3_ws100_range": z(f"list_max({_T3})-list_min({_T3})"), "ens3_ws100_min": z(f"list_min({_T3})"), "ens3_ws100_max": z(f"list_max({_T3})"),
    "forecast_vs_ens3": z("own-mu"), "forecast_ratio_ens3": z(f"own/{mx('mu')}"), "ens3_spread_trend_6h": z(lag_diff("sd", 6)), "ens4_ws100_mean": z("mu4"),
    "ens4_ws100_std": z("sd4"), "icon_shift_ens3": z("mu4-mu")}, {"ens3_spread_flag": "CASE WHEN sd > 2 THEN 1 ELSE 0 END"}) + " FROM k")
def consensus(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5", "gfs", "ecmwf", "icon")
    return added(h, ensemble.consensus_columns(h))


def ti(g: str, w: str) -> str:
    return f"CASE WHEN {g} IS NOT NULL THEN least(5.0e0, greatest(1.0e0, {g}/greatest({w}, 0.5e0))) END"


_TI = "[ta, tb, tc, td, te]"


@query("E03_turbulence", _ALL + f""", k AS (SELECT *, {ti('wind_gusts_10m', 'wind_speed_10m')} AS ta, {ti('gg', 'g10')} AS tb, {ti('cg', 'c10')} AS tc, {ti('eg', 'e10')} AS td, {ti('ig', 'i10')} AS te,
    CASE WHEN wind_speed_120m >= 7 AND wind_speed_120m < 10 THEN 1 ELSE 0 END AS st FROM j) SELECT """ + cols({
    "nwp_ti_10m": "ta", "gfs_ti_10m": "tb", "ecmwf_ti_10m": "tc", "era5_ti_10m": "td", "icon_ti_10m": "te", "ti_multi_mean": f"list_avg({_TI})", "ti_multi_std": f"list_stddev_pop({_TI})",
    "ti_multi_max": f"list_max({_TI})", "ti_x_steep_zone": f"list_avg({_TI})*st", "ti_spread_x_steep": f"list_stddev_pop({_TI})*st",
    "gust_excess_x_ws120": "greatest(0.0e0, wind_gusts_10m-wind_speed_10m)*wind_speed_120m"}, {"high_turbulence_flag": f"CASE WHEN list_avg({_TI}) > 1.8 THEN 1 ELSE 0 END"}) + " FROM k")
def turbulence(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5", "gfs", "ecmwf", "icon")
    h = h.withColumns({"gust_excess_10m": F.greatest(F.lit(0.0), F.col("wind_gusts_10m") - F.col("wind_speed_10m"))})
    return added(h, ensemble.turbulence_columns(h))


_SIX = "[own, e100, g100, c100, i100, n50*pow(2.0e0, 1.0e0/7.0e0)]"


@query("E04_rank", _ALL + f""", k AS (SELECT *, list_median({_SIX}) AS md FROM j),
   q AS (SELECT *, len(list_filter([coalesce(x, md) FOR x IN {_SIX}[2:]], lambda v: v < own)) AS rk, CASE WHEN wind_speed_120m >= 7 AND wind_speed_120m < 10 THEN 1 ELSE 0 END AS st FROM k)
   SELECT """ + cols({"nwp_vs_ens_median": "own-md", "nwp_rank_in_ens": "rk/5.0e0", "nwp_rank_centered": "rk/5.0e0-0.5e0", "nwp_vs_ens_median_sq": "pow(own-md, 2)", "nwp_rank_x_steep": "rk/5.0e0*st",
    "nwp_outlier_x_steep": "abs(own-md)*st"}, {"nwp_is_highest_flag": "CASE WHEN rk = 5 THEN 1 ELSE 0 END", "nwp_is_lowest_flag": "CASE WHEN rk = 0 THEN 1 ELSE 0 END"}) + " FROM q")
def rank(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5", "gfs", "ecmwf", "icon", "nasa")
    return added(h, ensemble.rank_columns(h))


@query("E05_circular_mean", _ALL + ", k AS (SELECT *, list_avg([sin(radians(gd)), sin(radians(cd)), sin(radians(idir))]) AS s, list_avg([cos(radians(gd)), cos(radians(cd)), cos(radians(idir))]) AS c FROM j) SELECT "
       + cols({"dir_mean_sin": "s", "dir_mean_cos": "c", "dir_mean_deg": "CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c))+360 ELSE degrees(atan2(s, c)) END"}) + " FROM k")
def circular_mean(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "gfs", "ecmwf", "icon")
    return added(h, ensemble.circular_mean_columns(h, ["gfs_dir100m", "ecmwf_dir100m", "icon_dir100m"], prefix="dir_mean"))


@query("E06_identical_columns", with_(HOURLY, "d AS (SELECT *, wind_speed_120m AS copy_a, wind_speed_120m*2 AS twice, power_mw AS copy_b FROM hourly)")
    + """SELECT kept, duplicate FROM (VALUES ('wind_speed_120m', 'copy_a', (SELECT count(*) FROM d WHERE wind_speed_120m IS DISTINCT FROM copy_a)),
      ('wind_speed_120m', 'twice', (SELECT count(*) FROM d WHERE wind_speed_120m IS DISTINCT FROM twice)), ('power_mw', 'copy_b', (SELECT count(*) FROM d WHERE power_mw IS DISTINCT FROM copy_b)),
      ('rain', 'snowfall', (SELECT count(*) FROM d WHERE rain IS DISTINCT FROM snowfall))) t(kept, duplicate, n) WHERE n = 0""")
def identical(spark, sf):
    h = hourly(spark, sf).withColumns({"copy_a": F.col("wind_speed_120m"), "twice": F.col("wind_speed_120m") * 2, "copy_b": F.col("power_mw")})
    return ensemble.identical_columns(h, ["wind_speed_120m", "wind_speed_80m", "power_mw", "rain", "snowfall", "copy_a", "twice", "copy_b"])


_CORR = ("wind_speed_120m", "wind_speed_80m", "wind_speed_180m", "temperature_80m", "temperature_120m", "power_mw")


@query("E07_correlation", with_(HOURLY, "f AS (SELECT " + ", ".join(f"coalesce({n}, (SELECT avg({n}) FROM hourly)) AS {n}" for n in _CORR) + " FROM hourly)")
    + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6)+0.0e0 AS correlation FROM f" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlation(spark, sf):
    return ensemble.correlation_table(hourly(spark, sf), _CORR)


# 47 columns: the first is constant, every fifth is a line of the one before it, one has missing values.
_WIDE = {"x0": "1.0e0"} | {f"x{k}": f"(((m*{15 + 2 * k})%101)/7.0e0)" for k in range(1, 47) if k % 5}
_WIDE |= {f"x{k}": f"({_WIDE[f'x{k - 1}']}*2.0e0+1.0e0)" for k in range(5, 47, 5)}
_WIDE["x7"] = f"CASE WHEN m%9=0 THEN NULL ELSE {_WIDE['x7']} END"
_WIDE = {f"x{k}": _WIDE[f"x{k}"] for k in range(47)}
_FAR = [(i, j) for j in range(47) for i in range(j)]


@query("E07_kept_columns", with_(HOURLY, "w AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WIDE.items()) + " FROM hourly)",
    "f AS (SELECT " + ", ".join(f"coalesce({n}, (SELECT avg({n}) FROM w)) AS {n}" for n in _WIDE) + " FROM w)",
    "r AS (SELECT " + ", ".join(f"covar_pop(x{i}, x{j})/nullif(stddev_pop(x{i})*stddev_pop(x{j}), 0) AS r{i}_{j}" for i, j in _FAR) + " FROM f)",
    "p AS (SELECT unnest([" + ", ".join(f"{{'i': {i}, 'j': {j}, 'r': r{i}_{j}}}" for i, j in _FAR) + "], recursive := true) FROM r)",
    "strong AS (SELECT j, list(i) AS near FROM p WHERE abs(coalesce(r, 0)) > 0.999e0 GROUP BY j)",
    """g AS (SELECT 0 AS i, [0] AS kept UNION ALL
      SELECT g.i+1, CASE WHEN len(list_intersect(kept, coalesce(near, []))) = 0 THEN list_append(kept, g.i+1) ELSE kept END FROM g LEFT JOIN strong ON strong.j = g.i+1 WHERE g.i < 46)""", recursive=True)
    + "SELECT n AS position, 'x' || n AS name, CAST(list_contains(kept, n) AS BIGINT) AS kept FROM g, range(47) t(n) WHERE g.i = 46")
def kept_columns(spark, sf):
    wide = hourly(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()])
    return ensemble.kept_columns(wide, list(_WIDE))
