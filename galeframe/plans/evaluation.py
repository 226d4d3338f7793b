"""Queries over scores, error reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.operators import evaluate, lookups, weather
from galeframe.plans.forecast import CAP, lim
from galeframe.plans.frames import base, with_feed
from galeframe.plans.lookups import iso_ctes, iso_lookup
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, cols, curve_ctes, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.sources import readers
from galeframe.sources.derived import hourly, oof


def ae(p: str) -> str:
    return f"abs(target_mw-{p})"


_SC = {"nmae_pct": f"avg({ae(lim('pred_cf_mw'))})/{CAP}*100", "mae_mw": f"avg({ae('pred_cf_mw')})", "bias_mw": "avg(target_mw-pred_cf_mw)"}


@query("D01_scores", with_(OOF) + "SELECT " + cols(_SC, {"n": "count(*)"}, keys="") + " FROM oof")
def scores(spark, sf):
    return evaluate.scores(oof(spark, sf), target="target_mw", pred="pred_cf_mw")


@query("D02_scores_by_fold", with_(OOF) + "SELECT " + cols(_SC, {"n": "count(*)", "fold": "fold"}, keys="") + " FROM oof GROUP BY fold")
def scores_by_fold(spark, sf):
    return evaluate.scores(oof(spark, sf), target="target_mw", pred="pred_cf_mw", keys=["fold"])


def label(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{a}-{b}'" for a, b in zip(edges[:-1], edges[1:])) + " END"


def report(ctes: str, source: str, groups: dict[str, str], y: str, p: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{g}' AS g, {e} AS k, {y} AS y, {p}-{y} AS e FROM {source}" for g, e in groups.items())
    return f"{ctes}, ll AS ({long}), tt AS (SELECT g, count(*) AS n, sum(abs(e)) AS a FROM ll GROUP BY 1) SELECT " + cols({
        "mean_target": "avg(y)", "share_rows_pct": "count(*)*100.0e0/any_value(tt.n)", "local_nmae_pct": f"avg(abs(e))/{CAP}*100", "share_error_pct": "sum(abs(e))*100/any_value(tt.a)",
        "bias_mw": "avg(e)", "mae_mw": "avg(abs(e))"}, {"n": "count(*)"}, keys="g AS grouping, k AS regime") + " FROM ll JOIN tt USING (g) WHERE k IS NOT NULL GROUP BY g, k"


_PH = with_(BASE, curve_ctes("base", "k", {"k120": ("wind_speed_120m", "air_density"), "k80": ("wind_speed_80m", "air_density")}),
    "ph AS (SELECT *, least(90.09e0, k120*active_turbines/1000.0e0) AS p120, least(90.09e0, k80*active_turbines/1000.0e0) AS p80 FROM k)")


@query("D03_regime_report", report(_PH, "ph", {"wind": label("wind_speed_120m", evaluate.CURVE_EDGES)}, "power_mw", "p120"))
def regime_report(spark, sf):
    """How wrong is the manufacturer power curve, by wind regime?"""
    b = weather.curve_power_columns(base(spark, sf))
    return evaluate.regime_report(b, {"wind": evaluate.wind_label("wind_speed_120m", evaluate.CURVE_EDGES)}, target=TARGET, pred="ds_120m_farm_mw")


_D4 = with_(BASE, feed_cte("reanalysis_v2"), """x AS (SELECT b.*, abs(b.wind_speed_120m-v.wind_speed_120m) AS gap, abs(b.wind_speed_120m-lag(b.wind_speed_120m, 3) OVER (PARTITION BY b.site_id ORDER BY b.ts)) AS rp,
   greatest(0.0e0, least(90.09e0, 5.5e0*b.wind_speed_120m)) AS pr FROM base b LEFT JOIN reanalysis_v2 v USING (site_id, ts))""",
   "q AS (SELECT quantile_cont(gap, [0.5, 0.75, 0.9]) AS g, quantile_cont(rp, [0.9, 0.95]) AS r, quantile_cont(air_density, [0.25, 0.75]) AS d FROM x)", "z AS (SELECT x.*, q.* FROM x, q)")


@query("D04_full_report", report(_D4, "z", {
    "wind": label("wind_speed_120m", evaluate.REGIME_EDGES), "disagreement": "CASE WHEN gap <= g[1] THEN '<=p50' WHEN gap <= g[2] THEN 'p50-p75' WHEN gap <= g[3] THEN 'p75-p90' WHEN gap IS NOT NULL THEN '>p90' END",
    "ramp": "CASE WHEN rp <= r[1] THEN '<=p90' WHEN rp <= r[2] THEN 'p90-p95' WHEN rp IS NOT NULL THEN '>p95' END",
    "hour": "CASE hour(ts)//6 WHEN 0 THEN '00-06' WHEN 1 THEN '06-12' WHEN 2 THEN '12-18' ELSE '18-24' END",
    "density": "CASE WHEN air_density < d[1] THEN 'low' WHEN air_density <= d[2] THEN 'mid' ELSE 'high' END", "repair": "CASE WHEN n_repair >= 3 THEN '3+' ELSE CAST(n_repair AS VARCHAR) END"}, "power_mw", "pr"))
def full_report(spark, sf):
    b = with_feed(spark, sf, base(spark, sf), "era5v2").withColumns({"pr": F.greatest(F.lit(0.0), F.least(F.lit(90.09), 5.5 * F.col("wind_speed_120m")))})
    return evaluate.full_report(b, target=TARGET, pred="pr")


_D5 = _PH.rstrip() + ", " + "pt AS (SELECT site_id, v_eff AS x, power_mw AS y FROM base WHERE power_mw >= 0), " + iso_ctes("iso", "pt") + ", cm AS " + iso_lookup("ph", "iso", "v_eff", "piso")
_G5 = {"all": "'all'", "wind": label("wind_speed_120m", evaluate.CURVE_EDGES), "hour": "CAST(hour(ts) AS VARCHAR)", "month": "CAST(month(ts) AS VARCHAR)"}


@query("D05_compare_models", _D5 + ", ll AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, {e} AS k, power_mw AS y, p120 AS a, piso AS b FROM cm" for g, e in _G5.items()) + ") SELECT " + cols({
    "mean_target": "avg(y)", **{f"{t}_{n}": f.format(p=p) for t, p in (("first", "a"), ("second", "b")) for n, f in (("bias_mw", "avg({p}-y)"), ("mae_mw", "avg(abs({p}-y))"), ("nmae_pct", "avg(abs(y-least(90.09e0, greatest(0.0e0, {p}))))/90.09e0*100"))}},
    {"n": "count(*)"}, keys="g AS grouping, k AS label") + " FROM ll WHERE k IS NOT NULL GROUP BY g, k")
def compare_models(spark, sf):
    b = weather.curve_power_columns(base(spark, sf))
    b = lookups.apply_site_curve(b, lookups.fit_site_curve(b), wind="v_eff", out="piso")
    return evaluate.compare_models(b, target=TARGET, first="ds_120m_farm_mw", second="piso")


_D6 = _PH.rstrip() + """, u AS (SELECT *, power_mw*1000.0e0/active_turbines AS kw FROM ph WHERE power_mw > 2 AND power_mw*1000.0e0/active_turbines < 3465*0.95e0 AND power_mw < p120*1.3e0),
 bi AS (SELECT site_id, ts, air_density, kw, 0 AS it, 3.0e0 AS lo, 25.0e0 AS hi FROM u UNION ALL SELECT site_id, ts, air_density, kw, it+1, CASE WHEN pm < kw THEN mid ELSE lo END, CASE WHEN pm < kw THEN hi ELSE mid END FROM (SELECT *, {pm} AS pm FROM (SELECT *, (lo+hi)/2 AS mid FROM bi WHERE it < 30))),
 iv AS (SELECT u.*, (bi.lo+bi.hi)/2 AS iw FROM u JOIN bi USING (site_id, ts) WHERE bi.it = 30)"""


def _d6() -> str:
    from galeframe.plans.oracle.base import curve_macro
    body = _D6.replace("{pm}", curve_macro("mid", "air_density")).replace("WITH ", "WITH RECURSIVE ", 1)
    long = " UNION ALL ".join(f"SELECT '{g}' AS g, {_G5[g]} AS k, wind_speed_120m AS w, iw FROM iv" for g in ("all", "wind", "hour"))
    return f"{body}, ll AS ({long}) SELECT " + cols({"mean_wind": "avg(w)", "mean_implied": "avg(iw)", "mean_bias": "avg(w-iw)"}, {"n": "count(*)"}, keys="g AS grouping, k AS label") + " FROM ll WHERE k IS NOT NULL GROUP BY g, k"


@query("D06_implied_wind", _d6())
def implied_wind(spark, sf):
    return evaluate.implied_wind_bias(weather.curve_power_columns(base(spark, sf)), physical="ds_120m_farm_mw")


_S7 = {"target": ("y", "0"), "cf": ("y/(active_turbines*3.465e0)", "0"), "residual": ("y-p120", "p120")}


@query("D07_variance", _PH.rstrip() + ", v AS (SELECT *, power_mw AS y, (SELECT avg(power_mw-p120) FROM ph) AS mr FROM ph) " + " UNION ALL ".join("SELECT " + cols({
    "mean": f"avg({e})", "std": f"stddev_pop({e})", "variance_share": f"var_pop({e})/var_pop(y)", "r2_wind": f"pow(corr(wind_speed_120m, {e}), 2)",
    "naive_nmae_pct": f"avg(abs(y-least(90.09e0, greatest(0.0e0, {b}+(SELECT avg({e}) FROM (SELECT *, power_mw AS y FROM ph))))))/90.09e0*100"}, keys=f"'{n}' AS series") + " FROM v" for n, (e, b) in _S7.items()))
def variance(spark, sf):
    b = weather.curve_power_columns(base(spark, sf))
    y, p = F.col(TARGET), F.col("ds_120m_farm_mw")
    return evaluate.variance_report(b, {"target": y, "cf": y / (F.col("active_turbines") * 3.465), "residual": y - p}, target=TARGET, base={"residual": p})


@query("D08_worst_rows", with_(OOF) + "SELECT " + cols({"abs_error": ae("pred_cf_mw")}, {"fold": "fold", "error_rank": "row_number() OVER (PARTITION BY fold ORDER BY abs(target_mw-pred_cf_mw) DESC, ts, site_id)"})
       + " FROM oof QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(target_mw-pred_cf_mw) DESC, ts, site_id) <= 20")
def worst_rows(spark, sf):
    return evaluate.worst_rows(oof(spark, sf), target="target_mw", pred="pred_cf_mw", n=20, keys=["fold"]).select("fold", SITE, TS, "abs_error", "error_rank")


@query("K01_top_overall", with_(OOF) + "SELECT " + cols({"abs_error": ae("pred_cf_mw")}) + " FROM oof ORDER BY abs(target_mw-pred_cf_mw) DESC, ts, site_id LIMIT 20")
def top_overall(spark, sf):
    return evaluate.worst_rows(oof(spark, sf), target="target_mw", pred="pred_cf_mw", n=20).select(SITE, TS, "abs_error")


@query("K02_submission_order", with_(OOF) + "SELECT " + cols({"pred_cf_mw": "pred_cf_mw"}, {"_submission_row": "row_number() OVER (ORDER BY ts DESC, site_id)-1"}) + " FROM oof ORDER BY ts DESC, site_id")
def submission_order(spark, sf):
    return readers.scoring_table(oof(spark, sf).select(SITE, TS, "pred_cf_mw")).orderBy("_submission_row")


_G9 = {"wind": "CASE WHEN wind_speed_80m > 0 AND wind_speed_80m <= 25 THEN len(list_filter([0,3,5,7,10,14], lambda e: e < wind_speed_80m))-1 END", "month": "month(ts)",
       "sector": "greatest(0, CAST(ceil(wind_direction_80m*1000/45.0e0) AS INT)-1)"}


@query("D09_residual_table", _PH.rstrip() + ", ll AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, {e} AS k, power_mw AS y, p80 AS p FROM ph" for g, e in _G9.items()) + ") SELECT " + cols({
    "mean_true": "avg(y)", "mean_pred": "avg(p)", "mean_abs_error": "avg(abs(p-y))", "bias": "avg(p-y)", "rmse": "sqrt(avg(pow(p-y, 2)))"}, {"bin": "k", "n": "count(*)"}, keys="g AS grouping") + " FROM ll WHERE k IS NOT NULL GROUP BY g, k")
def residual_table(spark, sf):
    return evaluate.residual_table(weather.curve_power_columns(base(spark, sf)), target=TARGET, pred="ds_80m_farm_mw")


@query("D10_compare_forecasts", with_(OOF) + "SELECT " + cols({"mean_diff": "avg(pred_cf_mw-pred_mw_mw)", "mean_abs_diff": "avg(abs(pred_cf_mw-pred_mw_mw))", "max_abs_diff": "max(abs(pred_cf_mw-pred_mw_mw))", "correlation": "corr(pred_cf_mw, pred_mw_mw)",
    **{f"{t}_{n}": f.format(p=p) for t, p in (("first", "pred_cf_mw"), ("second", "pred_mw_mw")) for n, f in (("mean", "avg({p})"), ("std", "stddev_pop({p})"), ("min", "min({p})"), ("max", "max({p})"),
       ("p05", "quantile_cont({p}, 0.05)"), ("p50", "median({p})"), ("p95", "quantile_cont({p}, 0.95)"))}}, {"n": "count(*)"}, keys="") + " FROM oof")
def compare_forecasts(spark, sf):
    return evaluate.compare_forecasts(oof(spark, sf), first="pred_cf_mw", second="pred_mw_mw")


_G10 = {"wind": "len(list_filter([3,5,7,10,13], lambda e: e <= wind_speed_120m))", "sector": "CAST(floor(wind_direction_120m*1000/45.0e0) AS INT)%8"}


@query("D10_compare_forecasts_by", _PH.rstrip() + ", ll AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, {e} AS k, p120 AS a, p80 AS b FROM ph" for g, e in _G10.items()) + ") SELECT " + cols({
    "first_mean": "avg(a)", "second_mean": "avg(b)", "mean_diff": "avg(a-b)", "mean_abs_diff": "avg(abs(a-b))"}, {"bin": "k", "n": "count(*)"}, keys="g AS grouping") + " FROM ll GROUP BY g, k")
def compare_forecasts_by(spark, sf):
    return evaluate.compare_forecasts_by(weather.curve_power_columns(base(spark, sf)), first="ds_120m_farm_mw", second="ds_80m_farm_mw")


@query("D11_leaderboard", with_(OOF) + " UNION ALL ".join("SELECT " + cols({**{f"f{f}": f"avg({ae(p)}) FILTER (fold = {f})/90.09e0*100" for f in (3, 4, 5)}, "all_folds": f"avg({ae(p)})/90.09e0*100"}, keys=f"'{n}' AS model") + " FROM oof"
       for n, p in (("cf", "pred_cf_mw"), ("mw", "pred_mw_mw"), ("mix", "(pred_cf_mw+pred_mw_mw)/2"))))
def leaderboard(spark, sf):
    o = oof(spark, sf).withColumns({"mix": (F.col("pred_cf_mw") + F.col("pred_mw_mw")) / 2.0})
    return evaluate.leaderboard(o, {"cf": "pred_cf_mw", "mw": "pred_mw_mw", "mix": "mix"}, target="target_mw", folds=(3, 4, 5))


@query("D12_regression_gate", with_(OOF) + "SELECT " + cols({"nmae_pct": f"avg({ae('pred_cf_mw')})/{CAP}*100", "baseline_pct": "7.62e0", "delta_pp": f"avg({ae('pred_cf_mw')})/{CAP}*100-7.62e0"},
       {"passed": f"CASE WHEN avg({ae('pred_cf_mw')})/{CAP}*100-7.62e0 <= 0.02 THEN 1 ELSE 0 END"}, keys="") + " FROM oof WHERE fold = 5")
def regression_gate(spark, sf):
    return evaluate.regression_gate(oof(spark, sf).filter("fold = 5"), target="target_mw", pred="pred_cf_mw", baseline_pct=7.62)


@query("D13_curve_fit", _PH.rstrip() + " " + " UNION ALL ".join("SELECT " + cols({"correlation": f"corr(power_mw, {p})", "mean_residual": f"avg(power_mw-{p})", "mean_abs_residual": f"avg(abs(power_mw-{p}))", "std_residual": f"stddev_samp(power_mw-{p})"},
       keys=f"'{n}' AS curve") + " FROM ph" for n, p in (("ds_80m_farm_mw", "p80"), ("ds_120m_farm_mw", "p120"))))
def curve_fit(spark, sf):
    return evaluate.curve_fit_report(weather.curve_power_columns(base(spark, sf)), ["ds_80m_farm_mw", "ds_120m_farm_mw"])


@query("D14_low_wind", with_(BASE, "l AS (SELECT year(ts) AS y, power_mw AS p, CASE WHEN v_eff < 5 THEN len(list_filter([1.5,2,2.5,3,3.5,4], lambda e: e <= v_eff)) END AS b, count(*) OVER (PARTITION BY year(ts)) AS t FROM base)") + "SELECT " + cols({
    "mean": "avg(p)", "zero_share": "avg(CASE WHEN p < 0.5 THEN 1 ELSE 0 END)", "share_pct": "count(*)*100.0e0/any_value(t)", "median": "median(p)", "p25": "quantile_cont(p, 0.25)", "p75": "quantile_cont(p, 0.75)"},
    {"year": "y", "ws_bin": "b", "n": "count(*)"}, keys="") + " FROM l WHERE b IS NOT NULL GROUP BY y, b")
def low_wind(spark, sf):
    return evaluate.low_wind_table(base(spark, sf))


_IC = {"below_0": "temperature_80m < 0", "below_2": "temperature_80m < 2", "classic": "temperature_80m < 0 AND rain+showers+snowfall > 0", "rime": "temperature_80m < 2 AND rain+showers+snowfall > 0",
       "snow": "temperature_80m < 0 AND snowfall > 0", "heavy_rime": "temperature_80m < 2 AND rain+showers+snowfall > 0 AND cloud_cover_low > 80"}


@query("D15_icing_counts", with_(HOURLY) + " UNION ALL ".join("SELECT " + cols({"share_pct": f"avg(CASE WHEN {e} THEN 1 ELSE 0 END)*100"}, {"year": "year(ts)", "n": f"count(*) FILTER ({e})"}, keys=f"'{n}' AS condition") + " FROM hourly GROUP BY year(ts)" for n, e in _IC.items()))
def icing_counts(spark, sf):
    return evaluate.icing_counts(hourly(spark, sf))


_IY = {**_IC, "none": "temperature_80m >= 2"}


@query("D15_icing_errors", _PH.rstrip() + " " + " UNION ALL ".join("SELECT " + cols({"bias_mw": "avg(power_mw-p120)", "nmae_pct": "avg(abs(power_mw-p120))/90.09e0*100",
       **{f"delta_{int(f * 100)}": f"(avg(abs(power_mw-p120*{f}e0))-avg(abs(power_mw-p120)))/90.09e0*100" for f in (0.85, 0.9, 0.95)}}, {"n": "count(*)"}, keys=f"'{n}' AS condition") + f" FROM ph WHERE {e} HAVING count(*) > 0" for n, e in _IY.items()))
def icing_errors(spark, sf):
    return evaluate.icing_errors(weather.curve_power_columns(base(spark, sf)), target=TARGET, pred="ds_120m_farm_mw")
