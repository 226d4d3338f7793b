"""Queries over post-processing, smoothing, analogs and the bias filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.operators import analogs, kalman, postprocess, smoothing
from galeframe.plans.frames import base, with_feed
from galeframe.plans.lookups import iso_ctes, iso_lookup
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, OOF_ORDERS, cols, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.sources.derived import hourly, oof, oof_orders

CAP = "90.09e0"


def lim(e: str, hi: str = CAP) -> str:
    return f"least({hi}, greatest(0.0e0, {e}))"


def err(e: str) -> str:
    return f"avg(abs(target_mw-{e}))/{CAP}*100"


_O = with_(OOF)
_STEP = "CASE WHEN ws_120 >= 18 THEN -12.976e0*{b} WHEN ws_120 >= 12 THEN -2.056e0*{a} ELSE 0 END-0.828e0*{s}"


@query("F01_regime_bias", _O + "SELECT " + cols({"corrected_mw": lim("pred_cf_mw+" + _STEP.format(a="0.7e0", b="0.5e0", s="0.7e0"))}) + " FROM oof")
def regime_bias(spark, sf):
    return postprocess.regime_bias_correction(oof(spark, sf), pred="pred_cf_mw", wind="ws_120").select(SITE, TS, "corrected_mw")


def _lfo(name: str, bin_expr: str, min_rows: int, shrink: int) -> str:
    """Correction per (site, bin, fold) by scanning the other folds directly."""
    return f"""{name}_r AS (SELECT site_id, fold, {bin_expr} AS b, target_mw-pred_cf_mw AS e FROM oof), {name}_k AS (SELECT DISTINCT site_id, fold, b FROM {name}_r),
 {name} AS (SELECT k.site_id, k.fold, k.b, CASE WHEN count(r.e) < {min_rows} THEN 0 ELSE avg(r.e)*count(r.e)/(count(r.e)+{shrink}.0e0) END AS v
   FROM {name}_k k LEFT JOIN {name}_r r ON r.site_id = k.site_id AND r.b = k.b AND r.fold <> k.fold GROUP BY 1, 2, 3)"""


_WBIN = "len(list_filter([2,4,6,8,10,12,14,16,18,25], lambda e: e <= ws_120))"
_F2 = with_(OOF, _lfo("lw", _WBIN, 5, 30), _lfo("lh", "hour(ts)//4", 5, 30), _lfo("lm", "month(ts)", 5, 30),
    f"x AS (SELECT o.*, lw.v AS vw, lh.v AS vh, lm.v AS vm FROM oof o JOIN lw ON lw.site_id = o.site_id AND lw.fold = o.fold AND lw.b = {_WBIN} JOIN lh ON lh.site_id = o.site_id AND lh.fold = o.fold AND lh.b = hour(o.ts)//4 "
    "JOIN lm ON lm.site_id = o.site_id AND lm.fold = o.fold AND lm.b = month(o.ts))", f"y AS (SELECT *, {lim('pred_cf_mw+vw')} AS p1 FROM x)", f"z AS (SELECT *, {lim('p1+0.5e0*' + lim('vh'))} AS p2 FROM y)")


@query("F02_shrunken_bias", _F2 + "SELECT " + cols({"wind_correction": "vw", "hour_correction": "vh", "month_correction": "vm", "corrected_mw": lim("p2+0.3e0*" + lim("vm"))}, {"fold": "fold"}) + " FROM z")
def shrunken_bias(spark, sf):
    d = postprocess.shrunken_bias_correction(oof(spark, sf), pred="pred_cf_mw", target="target_mw")
    return d.select("fold", SITE, TS, "wind_correction", "hour_correction", "month_correction", "corrected_mw")


_CBIN = "len(list_filter([3,5,7,8,9,10,11,12,14,16], lambda e: e <= ws_120))"


@query("F03_additive_calibration", with_(OOF, _lfo("lc", _CBIN, 10, 0), "t AS (SELECT site_id, fold, max(pred_cf_mw)*1.5e0 AS top FROM oof GROUP BY 1, 2)") + "SELECT " + cols({
    "wind_correction": "lc.v", "calibrated_mw": "least(t.top, greatest(0.0e0, pred_cf_mw+lc.v))"}, {"fold": "o.fold"}, keys="o.site_id, CAST(o.ts AS VARCHAR) AS ts")
    + f" FROM oof o JOIN lc ON lc.site_id = o.site_id AND lc.fold = o.fold AND lc.b = {_CBIN} JOIN t ON t.site_id = o.site_id AND t.fold = o.fold")
def additive_calibration(spark, sf):
    d = postprocess.additive_calibration(oof(spark, sf), pred="pred_cf_mw", target="target_mw")
    return d.select("fold", SITE, TS, "wind_correction", "calibrated_mw")


@query("F04_bias_shifts", with_(OOF, """s0 AS (SELECT site_id, avg(target_mw-pred_cf_mw) AS g, avg(target_mw-pred_cf_mw) FILTER (fold < 5 AND ws_120 >= 12 AND ws_120 < 18) AS h, count(*) FILTER (fold < 5 AND ws_120 >= 12 AND ws_120 < 18) AS nh,
   avg(target_mw-pred_cf_mw) FILTER (fold < 5 AND ws_120 >= 18) AS c, count(*) FILTER (fold < 5 AND ws_120 >= 18) AS nc FROM oof GROUP BY 1)""",
   "s AS (SELECT site_id, g, CASE WHEN nh > 10 THEN h*nh/(nh+30.0e0) ELSE 0 END AS h, CASE WHEN nc > 10 THEN c*nc/(nc+30.0e0) ELSE 0 END AS c FROM s0)") + "SELECT " + cols({
    "global_shifted_mw": lim("pred_cf_mw+g"), "wind_shifted_mw": lim("pred_cf_mw+CASE WHEN ws_120 >= 18 THEN c WHEN ws_120 >= 12 THEN h ELSE 0 END")}) + " FROM oof JOIN s USING (site_id)")
def bias_shifts(spark, sf):
    o = oof(spark, sf)
    s = postprocess.bias_shifts(o, pred="pred_cf_mw", target="target_mw", calibration=F.col("fold") < 5)
    return postprocess.apply_bias_shifts(o, s, pred="pred_cf_mw").select(SITE, TS, "global_shifted_mw", "wind_shifted_mw")


_F5 = with_(OOF, "hp AS (SELECT o.site_id, h.fold AS hf, o.pred_cf_mw AS x, o.target_mw AS y FROM oof o JOIN (SELECT DISTINCT fold FROM oof) h ON h.fold <> o.fold WHERE o.target_mw >= 0)",
    "hq AS (SELECT * FROM hp QUALIFY count(*) OVER (PARTITION BY site_id, hf) >= 100)", iso_ctes("iso", "hq", "site_id, hf"), "of AS (SELECT *, fold AS hf FROM oof)",
    "rc AS " + iso_lookup("of", "iso", "pred_cf_mw", "p", "site_id, hf"))


def _recal(spark, sf):
    return postprocess.isotonic_recalibration(oof(spark, sf), pred="pred_cf_mw", target="target_mw", folds=(3, 4, 5))


@query("F05_isotonic_recalibration", _F5 + "SELECT " + cols({"recalibrated_mw": "p"}, {"fold": "fold"}) + " FROM rc")
def isotonic_recalibration(spark, sf):
    return _recal(spark, sf).select("fold", SITE, TS, "recalibrated_mw")


@query("F05_recalibration_table", _F5 + "SELECT " + cols({"before_nmae_pct": err("pred_cf_mw"), "after_nmae_pct": err("p"), "delta_pp": f"{err('p')}-{err('pred_cf_mw')}"}, {"fold": "fold", "n": "count(*)"}, keys="") + " FROM rc GROUP BY fold")
def recalibration_table(spark, sf):
    return postprocess.recalibration_table(_recal(spark, sf), before="pred_cf_mw", after="recalibrated_mw", target="target_mw")


@query("F06_month_affine", with_(OOF_ORDERS, """f AS (SELECT month, regr_slope(y_true, y_pred) AS a, regr_intercept(y_true, y_pred) AS b, count(*) AS n FROM oof_orders GROUP BY 1)""") + "SELECT " + cols({
    "affine_mw": "CASE WHEN n >= 200 AND a BETWEEN 0.5 AND 1.5 THEN a*y_pred+b ELSE y_pred END"}, keys="row_id") + " FROM oof_orders JOIN f USING (month)")
def month_affine(spark, sf):
    o = oof_orders(spark, sf)
    p = postprocess.fit_month_affine(o, pred="y_pred", target="y_true")
    return postprocess.apply_affine(o, p, ["month"], pred="y_pred", out="affine_mw").select("row_id", "affine_mw")


@query("F07_regime_affine", with_(OOF, "o AS (SELECT *, len(list_filter([3,7,12,17], lambda e: e <= ws_120)) AS g FROM oof)",
    "f AS (SELECT g, regr_slope(target_mw, pred_cf_mw) AS a, regr_intercept(target_mw, pred_cf_mw) AS b, count(*) AS n FROM o WHERE fold < 5 GROUP BY 1)") + "SELECT " + cols({
    "affine_mw": f"CASE WHEN n >= 30 THEN {lim('least(1.3e0, greatest(0.7e0, a))*pred_cf_mw+least(10.0e0, greatest(-10.0e0, b))')} ELSE {lim('pred_cf_mw')} END"}) + " FROM o LEFT JOIN f USING (g)")
def regime_affine(spark, sf):
    d = postprocess.regime_affine(oof(spark, sf), pred="pred_cf_mw", target="target_mw", fit_filter=F.col("fold") < 5)
    return d.select(SITE, TS, "affine_mw")


K, K_SECTOR = 100, 50
_CUT = "2024-01-25 00:00:00"
_FEAT = ("wind_speed_120m*3.0e0", "wind_speed_80m", "wind_speed_10m", "temperature_80m", "pressure_msl/100.0e0", "wind_gusts_10m", "sin(2*pi()*hour(ts)/24)", "cos(2*pi()*hour(ts)/24)")
_HISTORY = ("b AS (SELECT *, 26-n_repair AS act, least(7, CAST(floor(wind_direction_120m*1000/45) AS INT)) AS sec, " + ", ".join(f"{e} AS f{i}" for i, e in enumerate(_FEAT)) + " FROM hourly)",
            f"t AS (SELECT * FROM b WHERE ts < TIMESTAMP '{_CUT}' AND power_mw BETWEEN 0 AND 90.09e0 AND NOT (wind_speed_120m > 8 AND power_mw < 5))", f"q AS (SELECT * FROM b WHERE ts >= TIMESTAMP '{_CUT}')")


def _knn(keys: str, k: int, *, train: str = "t", score: str = "q", name: str = "n") -> str:
    """CTEs that end in the k nearest training rows of each scoring row."""
    on = " AND ".join(f"t.{x.strip()} = q.{x.strip()}" for x in keys.split(","))
    st = ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(8))
    d = "+".join(f"pow((q.f{i}-t.f{i})/z.s{i}, 2)" for i in range(8))
    return f"""z{name} AS (SELECT {keys}, {st} FROM {train} GROUP BY {keys}),
    p{name} AS (SELECT q.site_id, q.ts, q.act, t.power_mw/greatest(t.act, 1) AS pt, sqrt({d}) AS dist, t.ts AS tts FROM {score} q JOIN {train} t ON {on} JOIN z{name} z ON {on.replace('t.', 'z.')}),
    {name} AS (SELECT * FROM p{name} QUALIFY row_number() OVER (PARTITION BY site_id, ts ORDER BY dist, tts) <= {k})"""


_BY_SITE = with_(HOURLY, *_HISTORY, _knn("site_id", K))
_BY_SECTOR = with_(HOURLY, *_HISTORY, f"e AS (SELECT site_id, sec FROM t GROUP BY 1, 2 HAVING count(*) >= {K_SECTOR})", "ts AS (SELECT t.* FROM t SEMI JOIN e USING (site_id, sec))",
    "qs AS (SELECT q.* FROM q SEMI JOIN e USING (site_id, sec))", "qw AS (SELECT q.* FROM q ANTI JOIN e USING (site_id, sec))", _knn("site_id, sec", K_SECTOR, train="ts", score="qs", name="ns"),
    _knn("site_id", K_SECTOR, score="qw", name="nw"), "n AS (SELECT *, 0 AS whole FROM ns UNION ALL SELECT *, 1 AS whole FROM nw)")
# every scoring row, with its analogs where there are any
_ALL = " FROM q LEFT JOIN n ON n.site_id = q.site_id AND n.ts = q.ts GROUP BY q.site_id, q.ts"
_QKEYS = "q.site_id, CAST(q.ts AS VARCHAR) AS ts"


def _split(spark, sf):
    b = base(spark, sf)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return b.filter(F.col(TS) < cut), b.filter(F.col(TS) >= cut)


@query("F08_analog_quantile", _BY_SITE + "SELECT " + cols({"analog_quantile_mw": f"CASE WHEN count(pt) > 0 THEN {lim('quantile_cont(pt, 0.55)*any_value(q.act)')} END", "analog_median_mw": f"CASE WHEN count(pt) > 0 THEN {lim('median(pt)*any_value(q.act)')} END"},
    {"n_analogs": "count(pt)", "whole_site": "1"}, keys=_QKEYS) + _ALL)
def analog_quantile(spark, sf):
    t, q = _split(spark, sf)
    return analogs.analog_forecast(t, q, target=TARGET, k=K).drop("analog_mean_mw")


@query("F09_analog_mean", _BY_SITE + "SELECT " + cols({"analog_mean_mw": f"CASE WHEN count(pt) > 0 THEN {lim('sum(pt/(dist+1e-6))/sum(1/(dist+1e-6))*any_value(q.act)')} END"}, keys=_QKEYS) + _ALL)
def analog_mean(spark, sf):
    t, q = _split(spark, sf)
    return analogs.analog_forecast(t, q, target=TARGET, k=K).select(SITE, TS, "analog_mean_mw")


@query("F10_analog_by_sector", _BY_SECTOR + "SELECT " + cols({"analog_median_mw": f"CASE WHEN count(pt) > 0 THEN {lim('median(pt)*any_value(q.act)')} END"}, {"n_analogs": "count(pt)", "whole_site": "coalesce(any_value(whole), 1)"}, keys=_QKEYS) + _ALL)
def analog_by_sector(spark, sf):
    from galeframe.functions.nullsafe import sector_clamped
    t, q = (d.withColumn("sector", sector_clamped(F.col("wind_direction_120m") * 1000.0, 8)) for d in _split(spark, sf))
    return analogs.analog_forecast(t, q, target=TARGET, k=K_SECTOR, keys=(SITE, "sector"), min_train=K_SECTOR).select(SITE, TS, "analog_median_mw", "n_analogs", "whole_site")


_POS = with_(OOF, "s AS (SELECT *, pred_cf_mw AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS n FROM oof WINDOW w AS (PARTITION BY site_id ORDER BY ts))")


def _sg(weights: str, offsets: list[int]) -> str:
    parts = []
    for w, o in zip(weights.split(), offsets):
        at = "p" if o == 0 else (f"lead(p, {o}) OVER w" if o > 0 else f"lag(p, {-o}) OVER w")
        parts.append(f"({w})*{at}")
    return "(" + "+".join(parts) + ")/35.0e0"


@query("F11_quadratic_smooth", _POS + f""", g AS (SELECT site_id, ts, CASE WHEN n < 5 THEN p WHEN i = 1 THEN {_sg('31 9 -3 -5 3', [0, 1, 2, 3, 4])} WHEN i = 2 THEN {_sg('9 13 12 6 -5', [-1, 0, 1, 2, 3])}
   WHEN i = n THEN {_sg('31 9 -3 -5 3', [0, -1, -2, -3, -4])} WHEN i = n-1 THEN {_sg('9 13 12 6 -5', [1, 0, -1, -2, -3])} ELSE {_sg('-3 12 17 12 -3', [-2, -1, 0, 1, 2])} END AS v FROM s WINDOW w AS (PARTITION BY site_id ORDER BY ts))
   SELECT """ + cols({"smooth_mw": lim("v")}) + " FROM g")
def quadratic_smooth(spark, sf):
    return smoothing.quadratic_smooth(oof(spark, sf).select(SITE, TS, "pred_cf_mw"), pred="pred_cf_mw").select(SITE, TS, "smooth_mw")


_SHIFT = _STEP.format(a="0.7e0", b="0.5e0", s="0.7e0")
_PATH = with_(OOF, *_HISTORY, _knn("site_id", K), f"a AS (SELECT site_id, ts, {lim('quantile_cont(pt, 0.55)*any_value(act)')} AS an FROM n GROUP BY 1, 2)",
    f"c AS (SELECT o.site_id, o.ts, {lim('pred_cf_mw+' + _SHIFT)} AS k, a.an FROM oof o LEFT JOIN a ON a.site_id = o.site_id AND a.ts = o.ts WHERE o.ts >= TIMESTAMP '{_CUT}')",
    "s AS (SELECT site_id, ts, 0.93e0*k+0.07e0*coalesce(an, k) AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS n FROM c WINDOW w AS (PARTITION BY site_id ORDER BY ts))")


@query("F00_forecast_path", _PATH + f""", g AS (SELECT site_id, ts, CASE WHEN n < 5 THEN p WHEN i = 1 THEN {_sg('31 9 -3 -5 3', [0, 1, 2, 3, 4])} WHEN i = 2 THEN {_sg('9 13 12 6 -5', [-1, 0, 1, 2, 3])}
   WHEN i = n THEN {_sg('31 9 -3 -5 3', [0, -1, -2, -3, -4])} WHEN i = n-1 THEN {_sg('9 13 12 6 -5', [1, 0, -1, -2, -3])} ELSE {_sg('-3 12 17 12 -3', [-2, -1, 0, 1, 2])} END AS v FROM s WINDOW w AS (PARTITION BY site_id ORDER BY ts))
   SELECT """ + cols({"forecast_mw": lim("v")}, {"_submission_row": "row_number() OVER (ORDER BY ts DESC, site_id)-1"}) + " FROM g")
def forecast_path(spark, sf):
    """The whole path of a forecast: regime correction, 7 % analog blend, smoothing in time order, limits, submission order."""
    train, score = _split(spark, sf)
    return postprocess.forecast_path(oof(spark, sf).filter(F.col(TS) >= F.lit(_CUT).cast("timestamp_ntz")), train, score, pred="pred_cf_mw", wind="ws_120", target=TARGET).select(SITE, TS, "_submission_row", "forecast_mw")


def _ema(alpha: str, order: str) -> str:
    return f"list_reduce(list(p) OVER (PARTITION BY site_id ORDER BY ts {order} ROWS BETWEEN 120 PRECEDING AND CURRENT ROW), lambda a, x: {alpha}*x+(1-{alpha})*a)"


@query("F12_exponential_smooth", _POS + "SELECT " + cols({"ema_mw": _ema("0.5e0", "ASC"), "ema_both_mw": f"({_ema('0.5e0', 'ASC')}+{_ema('0.5e0', 'DESC')})/2"}) + " FROM s")
def exponential_smooth(spark, sf):
    return smoothing.exponential_smooth(oof(spark, sf).select(SITE, TS, "pred_cf_mw"), pred="pred_cf_mw", span=3, both="ema_both_mw").drop("pred_cf_mw")


def _rmed(w: int) -> str:
    p = w // 2
    return f"""m{w} AS (SELECT a.site_id, a.ts, median(b.p) AS v FROM s a, range(-{p}, {p + 1}) o(o) JOIN s b ON b.site_id = a.site_id AND b.i = CASE WHEN a.i+o.o < 1 THEN 2-a.i-o.o WHEN a.i+o.o > a.n THEN 2*a.n-a.i-o.o ELSE a.i+o.o END GROUP BY 1, 2)"""


@query("F13_rolling_median", _POS + ", " + ", ".join(_rmed(w) for w in (3, 5, 7)) + " SELECT " + cols({f"median_{w}_mw": f"m{w}.v" for w in (3, 5, 7)}, keys="m3.site_id, CAST(m3.ts AS VARCHAR) AS ts") + " FROM m3 JOIN m5 USING (site_id, ts) JOIN m7 USING (site_id, ts)")
def rolling_median(spark, sf):
    o = oof(spark, sf).select(SITE, TS, "pred_cf_mw")
    return smoothing.rolling_median(o, pred="pred_cf_mw").drop("pred_cf_mw")


@query("F14_blend_scan", with_(OOF, f"g AS (SELECT fold, i AS position, printf('%.2f', i/20.0e0) AS candidate, avg(abs(target_mw-{lim('i/20.0e0*pred_mw_mw+(1-i/20.0e0)*pred_cf_mw')}))/{CAP}*100 AS e FROM oof, range(21) r(i) GROUP BY 1, 2, 3)")
    + "SELECT candidate, " + cols({"nmae_pct": "e"}, {"fold": "fold", "position": "position", "is_best": "CASE WHEN position = arg_min(position, (round(e, 9), position)) OVER (PARTITION BY fold) THEN 1 ELSE 0 END"}, keys="") + " FROM g")
def blend_scan(spark, sf):
    return postprocess.scan_weights(oof(spark, sf), postprocess.blend_grid("pred_cf_mw", "pred_mw_mw"), target="target_mw", keys=["fold"])


@query("F15_simplex_blend", with_(OOF, "o AS (SELECT *, least(90.09e0, 5.5e0*ws_120) AS c3 FROM oof)", f"""g AS (SELECT a.i || '/' || b.i || '/' || (10-a.i-b.i) AS candidate, a.i, b.i AS j, avg(abs(target_mw-{lim('a.i/10.0e0*pred_cf_mw+b.i/10.0e0*pred_mw_mw+(10-a.i-b.i)/10.0e0*c3')}))/{CAP}*100 AS e
    FROM o, range(11) a(i), range(11) b(i) WHERE a.i+b.i <= 10 GROUP BY a.i, b.i)""") + "SELECT candidate, " + cols({"nmae_pct": "e"}, {"position": "row_number() OVER (ORDER BY i, j)-1", "is_best": "CASE WHEN e = min(e) OVER () THEN 1 ELSE 0 END"}, keys="") + " FROM g")
def simplex_blend(spark, sf):
    o = oof(spark, sf).withColumns({"c3": F.least(F.lit(90.09), 5.5 * F.col("ws_120"))})
    return postprocess.scan_weights(o, postprocess.simplex_grid(["pred_cf_mw", "pred_mw_mw", "c3"]), target="target_mw")


@query("F16_fold_weighted_mean", _O + "SELECT " + cols({"pred_mw": "0.2e0*pred_cf_mw+0.3e0*pred_mw_mw+0.5e0*target_mw"}) + " FROM oof")
def fold_weighted_mean(spark, sf):
    o = oof(spark, sf)
    legs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(n).alias("p")) for f, n in ((2, "pred_cf_mw"), (3, "pred_mw_mw"), (4, "target_mw"))]))
    long = o.select(SITE, TS, legs.alias("l")).select(SITE, TS, F.col("l.f").alias("fold"), F.col("l.p").alias("p"))
    return postprocess.fold_weighted_mean(long, {2: 0.2, 3: 0.3, 4: 0.5}, pred="p")


@query("F17_icing_derate", with_(HOURLY) + "SELECT " + cols({"derated_mw": lim("power_mw*CASE WHEN rain+showers+snowfall > 0 AND temperature_80m < 0 THEN 0.9e0 WHEN rain+showers+snowfall > 0 AND temperature_80m < 2 THEN 0.92e0 ELSE 1 END")}) + " FROM hourly")
def icing_derate(spark, sf):
    return postprocess.icing_derate(hourly(spark, sf), pred=TARGET).select(SITE, TS, "derated_mw")


@query("F18_cut_limits", with_(BASE) + "SELECT " + cols({"hard_limited_mw": lim("CASE WHEN v_eff < 3 THEN 0 WHEN v_eff > 25 THEN least(power_mw, 5) ELSE power_mw END"), "soft_limited_mw": lim("power_mw/(1+exp(-(v_eff-2.6e0)*4/1.2e0))")}) + " FROM base")
def cut_limits(spark, sf):
    return postprocess.cut_limits(base(spark, sf), pred=TARGET).select(SITE, TS, "hard_limited_mw", "soft_limited_mw")


@query("F19_persistence", with_(OOF, "l AS (SELECT site_id, arg_max(target_mw, ts) AS last FROM oof WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1)", "w AS (SELECT *, CASE WHEN hour(ts) <= 2 THEN 0.5e0 WHEN hour(ts) = 3 THEN 0.7e0 ELSE 1 END AS k FROM oof WHERE ts >= TIMESTAMP '2024-01-28')")
       + "SELECT " + cols({"blended_mw": f"k*{lim('pred_cf_mw')}+(1-k)*last"}) + " FROM w JOIN l USING (site_id)")
def persistence(spark, sf):
    o, cut = oof(spark, sf), F.lit("2024-01-28").cast("timestamp_ntz")
    d = postprocess.persistence_blend(o.filter(F.col(TS) >= cut), o.filter(F.col(TS) < cut), pred="pred_cf_mw", target="target_mw")
    return d.select(SITE, TS, "blended_mw")


@query("F20_kalman_bias", with_(HOURLY, feed_cte("reanalysis"), """y AS (SELECT h.site_id, h.ts, h.wind_speed_120m AS w, h.wind_speed_120m-e.wind_speed_100m AS b, row_number() OVER (PARTITION BY h.site_id ORDER BY h.ts) AS i,
     count(*) OVER (PARTITION BY h.site_id) AS n FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts))""",
   """f AS (SELECT site_id, CAST(0 AS BIGINT) AS i, 0.0e0 AS x, 1.0e0 AS p FROM y WHERE i = 1 UNION ALL
     SELECT y.site_id, y.i, CASE WHEN y.b IS NULL THEN f.x ELSE f.x+(f.p+1e-4)/(f.p+1e-4+0.5e0)*(y.b-f.x) END, CASE WHEN y.b IS NULL THEN f.p+1e-4 ELSE (1-(f.p+1e-4)/(f.p+1e-4+0.5e0))*(f.p+1e-4) END
     FROM f JOIN y ON y.site_id = f.site_id AND y.i = f.i+1)""", "d AS (SELECT y.*, f.x, f.p FROM y JOIN f USING (site_id, i))",
   """b AS (SELECT site_id, i, x AS s FROM d WHERE i = n UNION ALL SELECT d.site_id, d.i, d.x+d.p/(d.p+1e-4)*(b.s-d.x) FROM b JOIN d ON d.site_id = b.site_id AND d.i = b.i-1)""", recursive=True)
   + "SELECT " + cols({"ws120_bias_kalman_smooth": "s", "ws120_kalman": "w-s"}) + " FROM d JOIN b USING (site_id, i)")
def kalman_bias(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return kalman.bias_columns(h).select(SITE, TS, "ws120_bias_kalman_smooth", "ws120_kalman")


_F21 = with_(HOURLY, feed_cte("reanalysis"), """y AS (SELECT h.site_id, h.ts, h.wind_speed_120m-e.wind_speed_100m AS b, row_number() OVER (PARTITION BY h.site_id ORDER BY h.ts) AS i
     FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts))""", "gr AS (SELECT unnest([1e-6, 1e-4, 1e-2, 1e-1, 1.0e0]) AS q)", "rr AS (SELECT unnest([0.1e0, 0.5e0, 2.0e0, 8.0e0, 32.0e0]) AS r)",
   """f AS (SELECT site_id, q, r, CAST(0 AS BIGINT) AS i, 0.0e0 AS x, 10.0e0 AS p, 0.0e0 AS ll, CAST(0 AS BIGINT) AS n FROM y, gr, rr WHERE i = 1 UNION ALL
     SELECT y.site_id, q, r, y.i, CASE WHEN y.b IS NULL THEN f.x ELSE f.x+(f.p+q)/(f.p+q+r)*(y.b-f.x) END, CASE WHEN y.b IS NULL THEN f.p+q ELSE (1-(f.p+q)/(f.p+q+r))*(f.p+q) END,
       f.ll-CASE WHEN y.b IS NULL THEN 0 ELSE 0.5e0*(ln(2*pi()*(f.p+q+r))+pow(y.b-f.x, 2)/(f.p+q+r)) END, f.n+CASE WHEN y.b IS NULL THEN 0 ELSE 1 END
     FROM f JOIN y ON y.site_id = f.site_id AND y.i = f.i+1)""", "l AS (SELECT * FROM f QUALIFY i = max(i) OVER (PARTITION BY site_id))", recursive=True)


def _likelihoods(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return kalman.likelihood_table(h, F.col("wind_speed_120m") - F.col("era5_wind_speed_100m"))


@query("F21_likelihoods", _F21 + "SELECT " + cols({"q": "q", "r": "r", "log_likelihood": "ll"}, {"n_observed": "n"}, keys="site_id") + " FROM l")
def likelihoods(spark, sf):
    return _likelihoods(spark, sf)


def _chosen(at_least: int) -> str:
    own = f"n >= {at_least}"
    return _F21 + "SELECT " + cols({"q": f"CASE WHEN {own} THEN q ELSE 1e-4 END", "r": f"CASE WHEN {own} THEN r ELSE 0.5e0 END", "p0": f"CASE WHEN {own} THEN 10.0e0 ELSE 1.0e0 END"}, {
        "n_observed": "n", "fitted": f"CASE WHEN {own} THEN 1 ELSE 0 END"}, keys="site_id") + " FROM l QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ll DESC, q, r) = 1"


@query("F21_kalman_parameters", _chosen(500))
def kalman_parameters(spark, sf):
    return kalman.choose_parameters(_likelihoods(spark, sf))


@query("F21_parameters_of_short_series", _chosen(20))
def kalman_parameters_short(spark, sf):
    """The same choice with a limit that these sites reach, so that both sides of it are exercised."""
    return kalman.choose_parameters(_likelihoods(spark, sf), min_rows=20)


@query("F22_alpha_blend", with_(OOF, f"x AS (SELECT *, {lim('pred_cf_mw+' + _STEP.format(a='0.7e0', b='0.5e0', s='0.7e0'))} AS k FROM oof)",
    f"g AS (SELECT i AS position, printf('%.2f', i/20.0e0) AS candidate, avg(abs(target_mw-{lim('i/20.0e0*k+(1-i/20.0e0)*pred_cf_mw')}))/{CAP}*100 AS e FROM x, range(21) r(i) GROUP BY 1, 2)")
    + "SELECT candidate, " + cols({"nmae_pct": "e"}, {"position": "position", "is_best": "CASE WHEN e = min(e) OVER () THEN 1 ELSE 0 END"}, keys="") + " FROM g")
def alpha_blend(spark, sf):
    o = postprocess.regime_bias_correction(oof(spark, sf), pred="pred_cf_mw", wind="ws_120")
    return postprocess.scan_weights(o, postprocess.blend_grid("pred_cf_mw", "corrected_mw"), target="target_mw")


_LAB = {"all": "'all'", "wind": "CASE WHEN ws_120 < 4 THEN 'calm' WHEN ws_120 < 8 THEN 'low' WHEN ws_120 < 12 THEN 'mid' WHEN ws_120 < 18 THEN 'high' WHEN ws_120 < 100 THEN 'cutout' END",
        "season": "CASE WHEN month(ts) <= 3 THEN 'q1' END", "day": "CASE WHEN hour(ts) >= 20 OR hour(ts) <= 3 THEN 'night' ELSE 'day' END", "month": "CAST(month(ts) AS VARCHAR)"}


@query("F23_conditional_bias", with_(OOF, "l AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, {e} AS label, target_mw-pred_cf_mw AS e FROM oof" for g, e in _LAB.items()) + ")") + "SELECT "
       + cols({"bias": "avg(e)"}, {"n": "count(*)"}, keys="g AS grouping, label") + " FROM l WHERE label IS NOT NULL GROUP BY g, label")
def conditional_bias(spark, sf):
    return postprocess.conditional_bias(oof(spark, sf), pred="pred_cf_mw", target="target_mw")


_LV = "[0.0e0, 0.3e0, 0.5e0, 0.7e0, 1.0e0]"
_LT = "['0', '0.3', '0.5', '0.7', '1']"


@query("F23_strength_sweep", with_(OOF, f"""g AS (SELECT a.i*25+b.i*5+s.i AS position, {_LT}[a.i+1] || '/' || {_LT}[b.i+1] || '/' || {_LT}[s.i+1] AS candidate,
   avg(abs(target_mw-{lim('pred_cf_mw+' + _STEP.format(a=_LV + '[a.i+1]', b=_LV + '[b.i+1]', s=_LV + '[s.i+1]'))}))/{CAP}*100 AS e FROM oof, range(5) a(i), range(5) b(i), range(5) s(i) GROUP BY a.i, b.i, s.i)""")
    + "SELECT candidate, " + cols({"nmae_pct": "e"}, {"position": "position", "is_best": "CASE WHEN e = min(e) OVER () THEN 1 ELSE 0 END"}, keys="") + " FROM g")
def strength_sweep(spark, sf):
    return postprocess.scan_weights(oof(spark, sf), postprocess.strength_grid("pred_cf_mw", "ws_120"), target="target_mw")


