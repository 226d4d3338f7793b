"""Queries over readers, writers, validation, gates and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.operators import cleaning, validation
from galeframe.operators.lookups import impute_upper_level
from galeframe.plans.frames import added, base, with_feed
from galeframe.plans.lookups import iso_ctes, iso_lookup
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, OOF_ORDERS, cols, curve_ctes, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.session import shared_folder
from galeframe.sources import readers, writers
from galeframe.sources.derived import feed, hourly, oof, oof_orders

# --- sources -------------------------------------------------------------------------------------


@query("S01_training_table", with_(HOURLY) + "SELECT " + cols({"power_mw": "power_mw", "wind_speed_120m": "wind_speed_120m"}, {"ws_180m_is_imputed": "0"}) + " FROM hourly")
def training_table(spark, sf):
    h = hourly(spark, sf).withColumn(TS, F.col(TS).cast("string"))
    return readers.training_table(h).select(SITE, TS, TARGET, "wind_speed_120m", "ws_180m_is_imputed")


@query("S02_scoring_table", with_(HOURLY) + "SELECT " + cols({"wind_speed_120m": "wind_speed_120m"}, {"_submission_row": "row_number() OVER (ORDER BY ts DESC, site_id)-1"}) + " FROM hourly")
def scoring_table(spark, sf):
    return readers.scoring_table(hourly(spark, sf)).select(SITE, TS, "wind_speed_120m", "_submission_row")


@query("S03_history_horizon", with_(HOURLY) + "SELECT " + cols({"power_mw": "CASE WHEN ts < TIMESTAMP '2024-01-29' THEN power_mw END"},
       {"is_history": "CASE WHEN ts < TIMESTAMP '2024-01-29' THEN 1 ELSE 0 END"}) + " FROM hourly")
def history_horizon(spark, sf):
    h = hourly(spark, sf)
    h = h.withColumns({TARGET: F.when(F.col(TS) < F.lit("2024-01-29").cast("timestamp_ntz"), F.col(TARGET)),
                       TS: (F.col(TS) + F.make_dt_interval(mins=F.pmod(F.col("m"), F.lit(59)).cast("int") - 29)).cast("timestamp_ntz")})
    past, ahead = readers.history_and_horizon(h)
    return past.withColumn("is_history", F.lit(1)).unionByName(ahead.withColumn("is_history", F.lit(0))).select(SITE, TS, TARGET, "is_history")


@query("S04_keyed_source", with_(feed_cte("reanalysis_v2")) + "SELECT " + cols({"era5v2_blh": "blh", "era5v2_cape": "cape"}) + " FROM reanalysis_v2")
def keyed_source(spark, sf):
    return readers.keyed_source(feed(spark, sf, "reanalysis_v2"), prefix="era5v2_", keep=("blh", "cape"))


def nested_files(spark, sf):
    """Hourly rows packed as one text per site and day; three key formats, -999 for a missing value."""
    h = hourly(spark, sf)
    kind = F.pmod(F.dayofmonth(TS), F.lit(3))
    key = F.when(kind == 0, F.date_format(TS, "yyyyMMddHHmm")).when(kind == 1, F.date_format(TS, "yyyyMMddHH")).otherwise(
        F.concat(F.date_format(TS, "yyyy"), F.lpad(F.dayofyear(TS).cast("string"), 3, "0"), F.date_format(TS, "HH")))

    def pack(value):
        return F.map_from_entries(F.collect_list(F.struct(key, value)))
    day = h.groupBy(SITE, F.to_date(TS).alias("day")).agg(
        pack(F.coalesce(F.col("wind_speed_180m"), F.lit(-999.0))).alias("a"), pack(F.col("temperature_80m")).alias("b"))
    doc = F.struct(F.struct(F.map_from_arrays(F.array(F.lit("WS180"), F.lit("T80")), F.array("a", "b")).alias("parameter")).alias("properties"))
    return day.select(F.concat_ws("/", F.col(SITE).cast("string"), F.col("day").cast("string")).alias("file_id"), F.to_json(doc).alias("text"))


@query("S05_nested_hours", with_(HOURLY) + "SELECT " + cols({"WS180": "wind_speed_180m", "T80": "temperature_80m"},
       keys="site_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS file_id, CAST(ts AS VARCHAR) AS time") + " FROM hourly")
def nested_hours(spark, sf):
    return readers.tidy_nested_hours(nested_files(spark, sf), ["WS180", "T80"])


@query("S06_combine", with_(HOURLY) + "SELECT " + cols({"power_mw": "CASE WHEN ts < TIMESTAMP '2024-01-21' THEN power_mw END"},
       keys="site_id, CAST(ts AS VARCHAR) AS ts, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'valid' END AS part") + " FROM hourly")
def combine(spark, sf):
    h, cut = hourly(spark, sf), F.lit("2024-01-21").cast("timestamp_ntz")
    both = readers.combine(h.filter(F.col(TS) < cut), h.filter(F.col(TS) >= cut).drop(TARGET))
    train, score = readers.split_back(both)
    return train.withColumn("part", F.lit("train")).unionByName(score.withColumn("part", F.lit("valid"))).select(SITE, TS, TARGET, "part")


def _preds(spark, sf):
    o = oof(spark, sf).select(SITE, TS, F.col("pred_cf_mw").alias("pred_mw"), F.col("ws_120").alias("wind_speed_120m"))
    return readers.with_position(o, order=[F.col(TS).desc(), F.col(SITE)], chunk=F.date_trunc("hour", F.col(TS).cast("timestamp")), descending=True)


_GATES = with_(OOF, "p AS (SELECT site_id, ts, pred_cf_mw AS pred, ws_120 AS ws FROM oof)", "hours AS (SELECT count(*) AS n FROM hourly)",
    "bins AS (SELECT len(list_filter([6, 8, 10, 12], lambda e: e <= ws)) AS b, median(pred) AS med FROM p WHERE ws >= 4 GROUP BY 1)", "steps AS (SELECT med, lag(med) OVER (ORDER BY b) AS before FROM bins)")


@query("S07_publish_gates", _GATES + """SELECT 'range' AS gate, count(*) AS n_violations FROM p WHERE pred IS NULL OR pred < 0 OR pred > 90.09e0
  UNION ALL SELECT 'row_count', CAST((SELECT count(*) FROM p) <> n AS BIGINT) FROM hours
  UNION ALL SELECT 'duplicate_timestamp', coalesce(CAST(sum(k-1) AS BIGINT), 0) FROM (SELECT count(*) AS k FROM p GROUP BY site_id, ts)
  UNION ALL SELECT 'wind_sanity', count(*) FROM p WHERE (ws < 1 AND pred >= 2) OR (ws > 25 AND pred >= 5)
  UNION ALL SELECT 'pct95_capacity', CAST(quantile_cont(pred, 0.95) > 90.09e0 AS BIGINT) FROM p
  UNION ALL SELECT 'wind_monotonicity', count(*) FROM steps WHERE med < before""")
def publish_gates(spark, sf):
    """Violations per gate; the expected number of rows is that of the hours, not of the forecast."""
    return validation.gate_results(_preds(spark, sf), expected=hourly(spark, sf).count(), order="_submission_row")


_RAMP = "CASE WHEN wind_speed_120m > 25 THEN 4.0e0 WHEN wind_speed_120m < 1 THEN 1.0e0 ELSE 7.5e0*wind_speed_120m END"


@query("S07_publish", with_(HOURLY) + "SELECT " + cols({"pred_mw": f"least(90.09e0, {_RAMP})"}, {"_submission_row": "row_number() OVER (ORDER BY ts DESC, site_id)-1"}) + " FROM hourly")
def publish(spark, sf):
    """Clip, validate, stage, run the gates and move into place twice over; then read what was published."""
    h = hourly(spark, sf)
    forecast = readers.scoring_table(h.select(SITE, TS, "wind_speed_120m").withColumn("pred_mw", F.expr(_RAMP)))
    path = f"{shared_folder(spark)}/forecast"
    for _ in range(2):  # the second time over a published forecast
        writers.publish_forecast(forecast, path, expected_rows=h.count())
    return spark.read.parquet(path).select(SITE, TS, "_submission_row", "pred_mw")


@query("S08_forecast_export", with_(OOF) + "SELECT CAST(row_number() OVER (ORDER BY ts DESC, site_id)-1 AS BIGINT) AS _submission_row, printf('%.6f', pred_cf_mw) AS value FROM oof")
def forecast_export(spark, sf):
    return writers.forecast_export(_preds(spark, sf), pred="pred_mw")


# --- cleaning ------------------------------------------------------------------------------------

_RULES = {
    "over_capacity": "power_mw > 90.09e0", "maintenance_zero": "26-n_repair <= 2 AND power_mw < 1",
    "rated_plateau_shortfall": "wind_speed_120m > 14 AND 26-n_repair >= 24 AND power_mw < 60",
    "low_wind_high_power": "(greatest(wind_speed_10m, wind_speed_80m, wind_speed_120m) < 4 AND wind_gusts_10m < 6 AND power_mw > 20)"
                           " OR (wind_speed_120m < 3 AND wind_gusts_10m < 5 AND power_mw > 15) OR (wind_speed_120m < 4 AND wind_gusts_10m < 7 AND power_mw > 30)"}
# Every rule must fire somewhere, so some readings are replaced where other readings say so.
_ODD = with_(HOURLY, """odd AS (SELECT * REPLACE (CASE WHEN cloud_cover_low = 3 THEN 25 ELSE n_repair END AS n_repair,
   CASE WHEN cloud_cover_low = 3 THEN 0.5e0 WHEN cloud_cover_low = 9 AND wind_speed_120m > 14 THEN 31.5e0 WHEN cloud_cover_low < 60 AND wind_speed_120m < 3 THEN 33.25e0 ELSE power_mw END AS power_mw) FROM hourly)""",
   "rl AS (SELECT *, " + ", ".join(f"({e}) AS is_{n}" for n, e in _RULES.items()) + " FROM odd)",
   "rs AS (SELECT *, CASE " + " ".join(f"WHEN is_{n} THEN '{n}'" for n in _RULES) + " ELSE '' END AS reason FROM rl)")


def odd(spark, sf):
    h, cloud, ws = hourly(spark, sf), F.col("cloud_cover_low"), F.col("wind_speed_120m")
    return h.withColumns({
        "n_repair": F.when(cloud == 3, F.lit(25)).otherwise(F.col("n_repair")),
        TARGET: F.when(cloud == 3, 0.5).when((cloud == 9) & (ws > 14), 31.5).when((cloud < 60) & (ws < 3), 33.25).otherwise(F.col(TARGET))})


@query("C01_rules", _ODD + "SELECT " + cols({}, {f"rule_{n}": f"CASE WHEN is_{n} THEN 1 ELSE 0 END" for n in _RULES}) + " FROM rl")
def rules(spark, sf):
    o = odd(spark, sf)
    return added(o, cleaning.impossible_rule_flags(o))


@query("C02_reasons", _ODD + "SELECT " + cols({}, {"_is_impossible": "CASE WHEN reason <> '' THEN 1 ELSE 0 END"}, keys="site_id, CAST(ts AS VARCHAR) AS ts, reason AS impossible_reason") + " FROM rs")
def reasons(spark, sf):
    o = odd(spark, sf)
    return added(o, cleaning.impossible_reasons(o))


@query("C03_rule_guard", _ODD + "SELECT " + cols({"flagged_share": "avg(CASE WHEN reason <> '' THEN 1.0e0 ELSE 0 END)", "allowed_share": "0.05e0"},
    {"n_rows": "count(*)", "n_flagged": "count(*) FILTER (reason <> '')", **{f"n_{n}": f"count(*) FILTER (is_{n})" for n in _RULES},
     "within_limit": "CASE WHEN avg(CASE WHEN reason <> '' THEN 1.0e0 ELSE 0 END) <= 0.05e0 THEN 1 ELSE 0 END"}, keys="") + " FROM rs")
def rule_guard(spark, sf):
    return cleaning.rule_guard(odd(spark, sf))


_W = "CASE WHEN reason <> '' THEN 0 WHEN year(ts) = 2024 THEN 0.7e0 ELSE 1 END"


@query("C04_training_weights", _ODD + "SELECT " + cols({"weight": _W}, keys="site_id, CAST(ts AS VARCHAR) AS ts, reason AS impossible_reason") + " FROM rs")
def weights(spark, sf):
    return cleaning.training_weights(odd(spark, sf), year=2024, year_factor=0.7).select(SITE, TS, "impossible_reason", "weight")


@query("C05_imputation_flag", with_(HOURLY) + "SELECT " + cols({}, {"ws_180m_is_imputed": "CASE WHEN wind_speed_180m IS NULL THEN 1 ELSE 0 END"}) + " FROM hourly")
def imputation_flag(spark, sf):
    h = hourly(spark, sf)
    after = impute_upper_level(h).drop("ws_180m_is_imputed")
    return cleaning.imputation_flag_between(h, after).select(SITE, TS, "ws_180m_is_imputed")


@query("C06_disagreement", with_(HOURLY, feed_cte("reanalysis")) + "SELECT " + cols({}, {"nwp_era5_disagreement": "CASE WHEN abs(h.wind_speed_120m-e.wind_speed_100m) > 5 THEN 1 ELSE 0 END"})
       + " FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts)")
def disagreement(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    return added(h, cleaning.disagreement_flag(h))


def _curtail(rows: str, expected: str, source: str) -> str:
    return f"""cx AS (SELECT *, {expected} AS expected FROM {source}), cr AS (SELECT *, CASE WHEN expected > 15 THEN power_mw/expected END AS ratio FROM cx),
 cf AS (SELECT *, CASE WHEN wind_speed_120m >= 5 AND expected >= 15 AND ratio < 0.75 THEN 1 ELSE 0 END AS f FROM cr),
 cs AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY site_id ORDER BY ts) THEN 0 ELSE 1 END AS st FROM cf), cg AS (SELECT *, sum(st) OVER (PARTITION BY site_id ORDER BY ts) AS run FROM cs),
 ch AS (SELECT *, CASE WHEN f = 1 AND count(*) OVER (PARTITION BY site_id, run) >= 2 THEN 1 ELSE 0 END AS flagged FROM cg)"""


_CC = dict(fraction=0.75, min_run_rows=2)
_CISO = with_(HOURLY, "hx AS (SELECT *, power_mw > 90.09e0 AS bad FROM hourly)", "pc AS (SELECT site_id, wind_speed_120m AS x, power_mw AS y FROM hx WHERE NOT bad AND power_mw >= 0)", iso_ctes("iso", "pc"),
    "ci AS " + iso_lookup("hx", "iso", "wind_speed_120m", "pe"), _curtail("", "pe", "ci"))
_CDS = with_(BASE, curve_ctes("base", "k", {"kw": ("wind_speed_120m", "air_density")}), _curtail("", "least(90.09e0, kw*active_turbines/1000.0e0)", "k"))
_CCOLS = cols({"expected": "expected", "ratio": "ratio"}, {"flagged_pre_run": "f", "flagged": "flagged"})


def _curtailed(spark, sf):
    h = hourly(spark, sf).withColumns({"_is_impossible": F.col(TARGET) > 90.09})
    return cleaning.curtailment_columns(h, cleaning.CurtailmentConfig(**_CC))


@query("C07_curtailment", _CISO + "SELECT " + _CCOLS + " FROM ch")
def curtailment(spark, sf):
    return _curtailed(spark, sf).select(SITE, TS, "expected", "ratio", "flagged_pre_run", "flagged")


@query("C07_curtailment_datasheet", _CDS + "SELECT " + _CCOLS + " FROM ch")
def curtailment_datasheet(spark, sf):
    d = cleaning.curtailment_columns(base(spark, sf), cleaning.CurtailmentConfig(curve="datasheet", **_CC))
    return d.select(SITE, TS, "expected", "ratio", "flagged_pre_run", "flagged")


@query("C08_curtailment_summary", _CISO + "SELECT " + cols({"mean_target_on_flagged": "coalesce(avg(power_mw) FILTER (flagged = 1), 0)", "mean_expected_on_flagged": "coalesce(avg(expected) FILTER (flagged = 1), 0)",
       "pct_flagged": "sum(flagged)*100.0e0/count(*)"}, {"total_rows": "count(*)", "pre_run_flagged": "sum(f)", "post_run_flagged": "sum(flagged)"}, keys="") + " FROM ch")
def curtailment_summary(spark, sf):
    return cleaning.curtailment_summary(_curtailed(spark, sf))


_RES = with_(OOF, "o AS (SELECT *, target_mw-pred_cf_mw AS r, least(30, greatest(0, CAST(floor(ws_120) AS INT))) AS b FROM oof)",
    "q AS (SELECT *, row_number() OVER (PARTITION BY site_id, b ORDER BY r) AS k, count(*) OVER (PARTITION BY site_id, b) AS n FROM o)",
    "mid AS (SELECT site_id, b, stddev_pop(r) AS sd, max(n) AS n, count(*) AS c FROM q WHERE k > floor(0.05e0*n) AND k <= n-floor(0.05e0*n) GROUP BY 1, 2)",
    "thr AS (SELECT site_id, b, 1.8e0*sd AS t FROM mid WHERE n >= 3 AND c > 1 AND sd > 0)", "fl AS (SELECT o.*, t, CASE WHEN abs(r) > t THEN 1 ELSE 0 END AS f FROM o LEFT JOIN thr USING (site_id, b))")


def _residuals(spark, sf):
    o = oof(spark, sf)
    truth = o.select(SITE, TS, F.col("target_mw").alias(TARGET), F.col("ws_120").alias("wind_speed_120m"))
    return cleaning.residual_flags(truth, o.select(SITE, TS, F.col("pred_cf_mw").alias("y_oof")), k=1.8, min_coverage=None)


@query("C09_residual_flags", _RES + "SELECT " + cols({"residual": "r", "threshold": "t"}, {"ws_bin": "b", "residual_flag": "f"}) + " FROM fl")
def residual_flags(spark, sf):
    return _residuals(spark, sf).select(SITE, TS, "residual", "threshold", "ws_bin", "residual_flag")


@query("C10_month_weights", with_(OOF_ORDERS) + "SELECT " + cols({"march": "CASE WHEN month = 3 THEN 3 ELSE 1 END", "winter": "CASE month WHEN 3 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END",
    "winter_soft": "CASE month WHEN 3 THEN 3 WHEN 1 THEN 1.5 WHEN 2 THEN 1.5 ELSE 1 END", "season": "CASE WHEN month IN (12,1,2) THEN 1.2 WHEN month BETWEEN 4 AND 9 THEN 0.5 ELSE 1 END"}, keys="row_id") + " FROM oof_orders")
def month_weights(spark, sf):
    o = oof_orders(spark, sf)
    for s in ("march", "winter", "winter_soft", "season"):
        o = cleaning.month_weights(o, scheme=s, deep_winter=1.2, out=s)
    return o.select("row_id", "march", "winter", "winter_soft", "season")


_END = "TIMESTAMP '2001-08-01 00:00:00'"


@query("C11_recency_weights", with_(OOF_ORDERS, f"a AS (SELECT *, greatest(0.0e0, epoch({_END}-ts)/3600.0e0) AS age FROM oof_orders)") + "SELECT " + cols({
    "time_weight": "exp(-1.5e0*age/max(age) OVER (PARTITION BY fold))", "recency_weight": f"pow(0.5e0, epoch({_END}-ts)/86400.0e0/180.0e0)",
    "year_weight": "CASE year(ts) WHEN 2022 THEN 1 WHEN 2023 THEN 1.5 WHEN 2024 THEN 2 WHEN 2025 THEN 3 ELSE 6 END"}, keys="row_id") + " FROM a")
def recency_weights(spark, sf):
    o = cleaning.decay_weights(oof_orders(spark, sf), train_end="2001-08-01 00:00:00", lam=1.5, keys=["fold"])
    return cleaning.year_weights(cleaning.half_life_weights(o, reference="2001-08-01 00:00:00")).select("row_id", "time_weight", "recency_weight", "year_weight")


@query("C12_band_weights", with_(HOURLY) + "SELECT " + cols({f"weight_{n}": f"CASE WHEN wind_speed_120m >= {lo} AND wind_speed_120m < {hi} THEN 2 ELSE 0.3 END" for n, lo, hi in (("low_0_7", 0, 7), ("mid_4_12", 4, 12), ("high_8_25", 8, 25))}) + " FROM hourly")
def band_weights(spark, sf):
    h = hourly(spark, sf)
    return added(h, cleaning.band_weights(h))


@query("C13_similarity_weights", with_(HOURLY, "p AS (SELECT *, 1/(1+exp(-(wind_speed_120m-15)/4)) AS p FROM hourly)", "q AS (SELECT *, ln(1+p*100) AS raw, sqrt(p+0.01e0) AS s, pow(p+0.005e0, 0.25e0) AS f FROM p)",
    "z AS (SELECT site_id, quantile_cont(raw, 0.95) AS p95, avg(s) AS ms, avg(f) AS mf FROM q GROUP BY 1)") + "SELECT " + cols({"adv_weight": "least(4.0e0, greatest(0.5e0, 0.5e0+raw/p95*3.5e0))",
    "av_soft_weight": "least(10.0e0, greatest(0.05e0, s/ms))", "av_pow4_weight": "least(10.0e0, greatest(0.05e0, f/mf))"}) + " FROM q JOIN z USING (site_id)")
def similarity_weights(spark, sf):
    h = hourly(spark, sf).withColumns({"p": 1.0 / (1.0 + F.exp(-(F.col("wind_speed_120m") - 15) / 4))})
    return cleaning.similarity_weights(h, prob="p").select(SITE, TS, "adv_weight", "av_soft_weight", "av_pow4_weight")


@query("S09_outlier_audit", _ODD + f"""SELECT site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, reason, printf('%.6f', 0.0e0) AS weight, printf('%.6f', wind_speed_120m) AS wind_speed_120m,
   CAST(26-n_repair AS BIGINT) AS active_turbines, printf('%.6f', CAST(power_mw AS DOUBLE)) AS target_value FROM rs WHERE reason <> ''""")
def outlier_audit(spark, sf):
    return writers.outlier_audit(cleaning.training_weights(odd(spark, sf)))


@query("S10_audit_header", _ODD + "SELECT " + cols({"imputed_180m_pct": "avg(CASE WHEN wind_speed_180m IS NULL THEN 1 ELSE 0 END)*100"},
    {"total_excluded": "count(*) FILTER (reason <> '')", **{f"n_{n}": f"count(*) FILTER (reason = '{n}')" for n in _RULES}}, keys="") + """,
   '# downweight_2022=1.000000 total_excluded=' || count(*) FILTER (reason <> '') || ' reasons={' || """ + " || ', ' || ".join(f"'{n}: ' || count(*) FILTER (reason = '{n}')" for n in _RULES)
   + """ || '} imputed_180m_pct=' || printf('%.1f', avg(CASE WHEN wind_speed_180m IS NULL THEN 1 ELSE 0 END)*100) AS header FROM rs""")
def audit_header(spark, sf):
    w = cleaning.training_weights(impute_upper_level(odd(spark, sf)))
    return writers.outlier_audit_header(w, year_factor=1.0)


@query("S11_residual_audit", _RES + """SELECT site_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, printf('%.6f', target_mw) AS y, printf('%.6f', pred_cf_mw) AS y_oof, printf('%.6f', r) AS residual,
   printf('%.6f', ws_120) AS ws_120m, CAST(b AS BIGINT) AS ws_bin, printf('%.6f', t) AS threshold, 'True' AS flagged FROM fl WHERE f = 1""")
def residual_audit(spark, sf):
    return writers.residual_audit(_residuals(spark, sf))


@query("S13_oof_wide", with_(OOF) + "SELECT " + cols({"target_mw": "target_mw", "ws_120": "ws_120", "cf": "pred_cf_mw/90.09e0", "mw": "pred_mw_mw"}, {"fold": "fold", "active_turbines": "active_turbines"}) + " FROM oof")
def oof_wide(spark, sf):
    o = oof(spark, sf)
    kinds = F.explode(F.array(F.struct(F.lit("cf").alias("target_mode"), (F.col("pred_cf_mw") / 90.09).alias("raw_pred")),
                              F.struct(F.lit("mw").alias("target_mode"), F.col("pred_mw_mw").alias("raw_pred"))))
    long = o.select("fold", SITE, TS, "target_mw", "active_turbines", "ws_120", kinds.alias("k")).select("*", "k.target_mode", "k.raw_pred").drop("k")
    return readers.oof_wide(long)


# --- validation and gates ------------------------------------------------------------------------

# Wrong readings are set where other readings say so, and some rows are repeated.
_DIRTY = with_(HOURLY, """d0 AS (SELECT * REPLACE (CASE WHEN rain > 2.1 THEN 30 ELSE n_repair END AS n_repair, CASE WHEN cloud_cover_low = 1 THEN -1.5e0 ELSE wind_speed_10m END AS wind_speed_10m,
   CASE WHEN cloud_cover_low = 2 THEN NULL ELSE wind_speed_80m END AS wind_speed_80m, CASE WHEN cloud_cover_low = 3 THEN wind_speed_10m*0.9e0 ELSE wind_gusts_10m END AS wind_gusts_10m,
   CASE WHEN cloud_cover_low = 4 THEN 61.25e0 ELSE temperature_2m END AS temperature_2m, CASE WHEN cloud_cover_low = 5 THEN -5.5e0 ELSE power_mw END AS power_mw), 1 AS copy, hour(ts) AS lead_hour FROM hourly)""",
   "dirty AS (SELECT * FROM d0 UNION ALL SELECT * REPLACE (2 AS copy) FROM d0 WHERE snowfall > 0.5)")


def dirty(spark, sf):
    h, k = hourly(spark, sf), F.col("cloud_cover_low")

    def put(cond, value, name):
        return F.when(cond, value).otherwise(F.col(name))
    d = h.withColumns({
        "n_repair": put(F.col("rain") > 2.1, F.lit(30), "n_repair"), "wind_gusts_10m": put(k == 3, F.col("wind_speed_10m") * 0.9, "wind_gusts_10m"),
        "wind_speed_10m": put(k == 1, F.lit(-1.5), "wind_speed_10m"), "wind_speed_80m": put(k == 2, F.lit(None), "wind_speed_80m"),
        "temperature_2m": put(k == 4, F.lit(61.25), "temperature_2m"), TARGET: put(k == 5, F.lit(-5.5), TARGET), "copy": F.lit(1), "lead_hour": F.hour(TS)})
    return d.unionByName(d.filter(F.col("snowfall") > 0.5).withColumn("copy", F.lit(2)))


def _cells(*parts: tuple[str, str, str, str]) -> str:
    return "cells AS (" + " UNION ALL ".join(
        f"SELECT site_id, CAST(ts AS VARCHAR) AS ts, '{c}' AS column_name, '{k}' AS check_name, CAST({v} AS DOUBLE) AS failure_value FROM dirty WHERE {w}" for c, k, v, w in parts) + ")"


_DUP = ("ts", "field_uniqueness", "NULL", "(site_id, ts) IN (SELECT (site_id, ts) FROM dirty GROUP BY site_id, ts HAVING count(*) > 1)")
_V1 = (("power_mw", "in_range", "power_mw", "power_mw < 0 OR power_mw > 90.09e0"), ("n_repair", "in_range", "n_repair", "n_repair > 26"), _DUP)
_V2 = (*[(f"wind_speed_{h}", "in_range", f"wind_speed_{h}", f"wind_speed_{h} < 0 OR wind_speed_{h} > 60") for h in ("10m", "80m", "120m", "180m")],
       *[(f"wind_speed_{h}", "not_nullable", "NULL", f"wind_speed_{h} IS NULL") for h in ("10m", "80m", "120m")],
       ("wind_gusts_10m", "in_range", "wind_gusts_10m", "wind_gusts_10m < 0 OR wind_gusts_10m > 60"), ("temperature_2m", "in_range", "temperature_2m", "temperature_2m < -40 OR temperature_2m > 50"),
       ("<dataframe>", "gust_ge_ws_10m", "wind_gusts_10m", "wind_gusts_10m < wind_speed_10m"))
_CELL = "SELECT site_id, ts, column_name, check_name, round(failure_value, 6)+0.0e0 AS failure_value FROM cells"


@query("V01_training_rules", _DIRTY + ", " + _cells(*_V1) + " " + _CELL)
def training_rules(spark, sf):
    return validation.failing_cells(dirty(spark, sf), validation.TRAINING_RULES)


@query("V02_weather_rules", _DIRTY + ", " + _cells(*_V2) + " " + _CELL)
def weather_rules(spark, sf):
    return validation.failing_cells(dirty(spark, sf), validation.WEATHER_RULES)


_DIRTY_LEAD = _DIRTY.replace("hour(ts) AS lead_hour", "nullif(hour(ts), 23) AS lead_hour")


@query("V03_forecast_rules", _DIRTY_LEAD + ", " + _cells(*_V2, ("lead_hour", "not_nullable", "NULL", "lead_hour IS NULL")) + " " + _CELL)
def forecast_rules(spark, sf):
    d = dirty(spark, sf).withColumn("lead_hour", F.when(F.col("lead_hour") != 23, F.col("lead_hour")))
    return validation.failing_cells(d, validation.FORECAST_RULES)


@query("V04_output_rules", _DIRTY + ", " + _cells(("power_mw", "in_range", "power_mw", "power_mw < 0 OR power_mw > 90.09e0"), _DUP) + " " + _CELL
       + " UNION ALL SELECT NULL, NULL, '<dataframe>', 'row_count', CAST(count(*) AS DOUBLE) FROM dirty HAVING count(*) NOT IN (24, 2126)")
def output_rules(spark, sf):
    return validation.failing_cells(dirty(spark, sf), validation.output_rules())


@query("V05_gust_below_mean", _DIRTY + " SELECT " + cols({"wind_gusts_10m": "wind_gusts_10m", "wind_speed_10m": "wind_speed_10m"}, {"copy": "copy"}) + " FROM dirty WHERE wind_gusts_10m < wind_speed_10m")
def gust_below_mean(spark, sf):
    return dirty(spark, sf).filter(validation.gust_below_mean()).select(SITE, TS, "copy", "wind_gusts_10m", "wind_speed_10m")


_SEV = "CASE WHEN check_name = 'field_uniqueness' OR (column_name = 'power_mw' AND failure_value > 90.09e0) THEN 'fatal' ELSE 'warning' END"


@query("V06_severity", _DIRTY + ", " + _cells(*_V1) + f" SELECT site_id, ts, column_name, check_name, round(failure_value, 6)+0.0e0 AS failure_value, {_SEV} AS severity FROM cells")
def severity(spark, sf):
    return validation.with_severity(validation.failing_cells(dirty(spark, sf), validation.TRAINING_RULES))


@query("V07_warning_counts", _DIRTY + ", " + _cells(*_V2) + " SELECT column_name, check_name, count(*) AS n_cells FROM cells GROUP BY 1, 2")
def warning_counts(spark, sf):
    return validation.warning_counts(validation.failing_cells(dirty(spark, sf), validation.WEATHER_RULES))


@query("S12_validation_report", _DIRTY + ", " + _cells(*_V1) + f""" SELECT CASE WHEN count(*) FILTER ({_SEV} = 'fatal') > 0 THEN 'fatal' WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status,
   (SELECT count(*) FROM dirty) AS n_rows, count(*) AS n_failures, count(*) FILTER ({_SEV} = 'fatal') AS n_fatal, CAST(count(*) > 1000 AS BIGINT) AS failure_cases_truncated, least(1000, count(*)) AS n_listed FROM cells""")
def validation_report(spark, sf):
    return validation.validation_report(dirty(spark, sf), validation.TRAINING_RULES, failures_path=shared_folder(spark)).drop("failure_cases", "failures_path")


@query("S12_failure_table", _DIRTY + ", " + _cells(*_V1) + f" SELECT site_id, ts, column_name, check_name, round(failure_value, 6)+0.0e0 AS failure_value, {_SEV} AS severity FROM cells")
def failure_table(spark, sf):
    path = shared_folder(spark)
    validation.validation_report(dirty(spark, sf), validation.TRAINING_RULES, failures_path=path)
    return spark.read.parquet(path)


@query("K03_capped_failures", _DIRTY + ", " + _cells(*_V1) + " SELECT column_name, check_name, site_id, ts FROM cells ORDER BY column_name, check_name, site_id, ts LIMIT 1000")
def capped_failures(spark, sf):
    cells = validation.failing_cells(dirty(spark, sf), validation.TRAINING_RULES)
    return validation.listed_failures(cells).select("column_name", "check_name", SITE, TS)


def _gated(spark, sf):
    return dirty(spark, sf).select(SITE, TS, "copy", F.col(TARGET).alias("pred_mw"), "wind_speed_120m")


_P = cols({"pred_mw": "power_mw", "wind_speed_120m": "wind_speed_120m"}, {"copy": "copy"})


@query("G01_range", _DIRTY + f" SELECT {_P} FROM dirty WHERE power_mw < 0 OR power_mw > 90.09e0 OR power_mw IS NULL")
def gate_range(spark, sf):
    return validation.gate_range(_gated(spark, sf))


@query("G02_row_count", _DIRTY + " SELECT count(*) AS n_rows, CAST(2126 AS BIGINT) AS expected_rows FROM dirty HAVING count(*) <> 2126")
def gate_row_count(spark, sf):
    return validation.gate_row_count(_gated(spark, sf), expected=2126)


@query("G03_duplicates", _DIRTY + f" SELECT {_P} FROM dirty QUALIFY row_number() OVER (PARTITION BY site_id, ts ORDER BY copy) > 1")
def gate_duplicates(spark, sf):
    return validation.gate_duplicates(_gated(spark, sf), order="copy")


@query("G04_wind_sanity", _DIRTY + f" SELECT {_P} FROM dirty WHERE (wind_speed_120m < 1 AND power_mw >= 2) OR (wind_speed_120m > 25 AND power_mw >= 5)")
def gate_wind_sanity(spark, sf):
    return validation.gate_wind_sanity(_gated(spark, sf))


@query("G05_high_percentile", _DIRTY + " SELECT " + cols({"pct95": "quantile_cont(power_mw, 0.95)"}, {"within_limit": "CASE WHEN quantile_cont(power_mw, 0.95) <= 90.09e0 THEN 1 ELSE 0 END"}, keys="") + " FROM dirty")
def gate_high_percentile(spark, sf):
    return validation.gate_high_percentile(_gated(spark, sf))


_G6 = """, gb AS (SELECT least(4, CAST(floor((wind_speed_120m-4)/2) AS INT)) AS wind_bin, CASE WHEN wind_speed_120m >= 10 AND wind_speed_120m < 12 THEN power_mw*0.3e0 ELSE power_mw END AS p FROM dirty WHERE wind_speed_120m >= 4),
 gm AS (SELECT wind_bin, median(p) AS med FROM gb GROUP BY 1), gl AS (SELECT *, lag(med) OVER (ORDER BY wind_bin) AS prev FROM gm)"""


@query("G06_monotonic", _DIRTY + _G6 + " SELECT " + cols({"median_mw": "med", "previous_mw": "prev"}, {"wind_bin": "wind_bin"}, keys="") + " FROM gl WHERE med < prev")
def gate_monotonic(spark, sf):
    g, ws = _gated(spark, sf), F.col("wind_speed_120m")
    return validation.gate_monotonic(g.withColumns({"pred_mw": F.when((ws >= 10) & (ws < 12), F.col("pred_mw") * 0.3).otherwise(F.col("pred_mw"))}))

