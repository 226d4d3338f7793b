"""Queries over the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.functions.nullsafe import flag
from galeframe.operators import weather, windows
from galeframe.plans.frames import added, with_feed
from galeframe.plans.oracle.base import HOURLY, cols, feed_cte, with_
from galeframe.plans.registry import query
from galeframe.sources.derived import hourly, oof

OVER = "OVER (PARTITION BY site_id ORDER BY ts"


def rows(n: int) -> str:
    return f"{OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def past(n: int) -> str:
    return f"{OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def mean(c: str, n: int, m: int = 1) -> str:
    return f"CASE WHEN count({c}) {rows(n)} >= {m} THEN avg({c}) {rows(n)} END"


def std(c: str, n: int, m: int = 1) -> str:
    return f"coalesce(CASE WHEN count({c}) {rows(n)} >= {max(m, 2)} THEN stddev_samp({c}) {rows(n)} END, 0)"


def delta(c: str, n: int) -> str:
    return f"({c}-lag({c}, {n}) {OVER}))"


def delta0(c: str, n: int) -> str:
    return f"coalesce({delta(c, n)}, 0)"


# The reanalysis merged onto the hourly table, missing hours as 0.
ERA = with_(HOURLY, feed_cte("reanalysis"), """e AS (SELECT h.*, coalesce(r.wind_speed_100m, 0.0e0) AS w, coalesce(r.pressure_msl, 0.0e0) AS p,
  coalesce(sin(radians(r.wind_direction_100m)), 0.0e0) AS ds, coalesce(cos(radians(r.wind_direction_100m)), 0.0e0) AS dc
  FROM hourly h LEFT JOIN reanalysis r USING (site_id, ts))""")


def era(spark, sf):
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    rad = F.radians("era5_wind_direction_100m")
    h = h.withColumns({"era5_dir100_sin": F.sin(rad), "era5_dir100_cos": F.cos(rad)})
    return h.fillna(0.0, [c for c in h.columns if c.startswith("era5_")])


@query("W01_rolling", ERA + "SELECT " + cols({
    **{f"era5_ws100_roll_mean_{n}h": mean("w", n) for n in (2, 3, 6, 12, 24, 48, 72)},
    **{f"era5_ws100_roll_std_{n}h": std("w", n) for n in (2, 3, 6, 12, 24, 48, 72)}}) + " FROM e")
def rolling(spark, sf):
    e = era(spark, sf)
    return added(e, windows.rolling_columns(e, "era5_wind_speed_100m", prefix="era5_ws100", rows=(2, 3, 6, 12, 24, 48, 72)))


@query("W01_rolling_by_time", ERA + "SELECT " + cols({k: v for n in (3, 6, 24) for k, v in {
    f"era5_ws100_roll_mean_{n}h": f"avg(w) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL {n * 3600 - 1} SECOND PRECEDING AND CURRENT ROW)",
    f"era5_ws100_roll_std_{n}h": f"coalesce(CASE WHEN count(w) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL {n * 3600 - 1} SECOND PRECEDING AND CURRENT ROW) > 1 THEN stddev_samp(w) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL {n * 3600 - 1} SECOND PRECEDING AND CURRENT ROW) END, 0)",
    }.items()}) + " FROM e")
def rolling_by_time(spark, sf):
    e = era(spark, sf)
    return added(e, windows.rolling_columns_by_time(e, "era5_wind_speed_100m", prefix="era5_ws100", hours=(3, 6, 24)))


_DIFFS = {f"era5_ws100_diff{n}": ("w", n) for n in (1, 3, 6, 24, 48)} | {f"era5_pressure_diff{n}": ("p", n) for n in (3, 6, 12)}


@query("W02_differences", ERA + "SELECT " + cols({k: delta0(*v) for k, v in _DIFFS.items()}) + " FROM e")
def differences(spark, sf):
    e = era(spark, sf)
    real = {"w": "era5_wind_speed_100m", "p": "era5_pressure_msl"}
    return added(e, windows.difference_columns(e, {k: (real[c], n) for k, (c, n) in _DIFFS.items()}))


@query("W03_gustiness", ERA + "SELECT " + cols({
    "era5_turb_intensity_6h": f"{std('w', 6)}/({mean('w', 6)}+0.001e0)", "era5_dir_sin_diff1": delta0("ds", 1),
    "era5_dir_cos_diff1": delta0("dc", 1)}) + " FROM e")
def gustiness(spark, sf):
    e = era(spark, sf)
    return added(e, windows.gustiness_columns(e, "era5_wind_speed_100m", "era5_dir100_sin", "era5_dir100_cos", prefix="era5"))


_SOFT = "least(1.0e0, greatest(0.0e0, 3-wind_speed_120m))"


@query("W04_ramps", with_(HOURLY) + "SELECT " + cols({
    **{f"dv_{n}h": delta0("wind_speed_120m", n) for n in (3, 6)}, "is_sub_cutin_soft": _SOFT,
    **{f"dv_{n}h_x_sub_cutin": f"{delta0('wind_speed_120m', n)}*{_SOFT}" for n in (3, 6)},
    **{f"abs_dv_{n}h": f"abs({delta0('wind_speed_120m', n)})" for n in (3, 6)}},
    {"is_sub_cutin": "CASE WHEN wind_speed_120m < 2 THEN 1 ELSE 0 END"}) + " FROM hourly")
def ramps(spark, sf):
    h = hourly(spark, sf)
    return added(h, windows.ramp_columns(h))


def _ahead(c: str, n: int) -> str:
    return f"lead({c}, {n}) {OVER})"


@query("W05_leads", with_(HOURLY) + "SELECT " + cols({
    **{f"struct_nwp_lead{n}h": f"coalesce({_ahead('wind_speed_120m', n)}, 0)" for n in (3, 6, 12, 24)},
    **{f"struct_nwp_ramp_{n}h": f"coalesce({_ahead('wind_speed_120m', n)}-wind_speed_120m, 0)" for n in (6, 12)},
    **{f"struct_dp_future_{n}h": f"coalesce({_ahead('pressure_msl', n)}-pressure_msl, 0)" for n in (6, 12)}}) + " FROM hourly")
def leads(spark, sf):
    h = hourly(spark, sf)
    return added(h, windows.lead_columns(h))


_D120 = {"s": "sin(radians(wind_direction_120m*1000.0e0))", "c": "cos(radians(wind_direction_120m*1000.0e0))"}
_HD = with_(HOURLY, f"hd AS (SELECT *, {_D120['s']} AS s, {_D120['c']} AS c FROM hourly)")


@query("W06_forecast_rolling", _HD + "SELECT " + cols({
    **{f"nwp_ws120_roll_mean_{n}h": mean("wind_speed_120m", n) for n in (3, 6, 12, 24)},
    **{f"nwp_ws120_roll_std_{n}h": std("wind_speed_120m", n) for n in (3, 6, 12, 24)},
    **{f"nwp_ws120_diff{n}": delta0("wind_speed_120m", n) for n in (1, 3, 6)},
    **{f"nwp_pressure_diff{n}": delta0("pressure_msl", n) for n in (3, 6, 12)},
    "nwp_turb_intensity_6h": f"{std('wind_speed_120m', 6)}/({mean('wind_speed_120m', 6)}+0.001e0)",
    "nwp_dir_sin_diff1": delta0("s", 1), "nwp_dir_cos_diff1": delta0("c", 1)}) + " FROM hd")
def forecast_rolling(spark, sf):
    h = weather.direction_columns(hourly(spark, sf))
    return added(h, windows.source_rolling_set(h, wind="wind_speed_120m", pressure="pressure_msl", dir_sin="wind_dir_120m_sin",
                                               dir_cos="wind_dir_120m_cos", wind_prefix="nwp_ws120", prefix="nwp"))


_MULTI = with_(HOURLY, feed_cte("gfs"), feed_cte("ecmwf"), feed_cte("reanalysis"), """mm AS (SELECT h.*, g.wind_speed_100m AS g, c.wind_speed_100m AS k,
  list_stddev_pop([r.wind_speed_100m, g.wind_speed_100m, c.wind_speed_100m]) AS sd,
  list_avg([r.wind_speed_100m, g.wind_speed_100m, c.wind_speed_100m]) AS mu,
  sin(radians(g.wind_direction_100m)) AS gs, cos(radians(g.wind_direction_100m)) AS gc, g.wind_direction_100m AS gd, c.wind_direction_100m AS kd
  FROM hourly h LEFT JOIN gfs g USING (site_id, ts) LEFT JOIN ecmwf c USING (site_id, ts) LEFT JOIN reanalysis r USING (site_id, ts))""")


def multi(spark, sf):
    from galeframe.functions.rowstats import row_std
    h = with_feed(spark, sf, hourly(spark, sf), "gfs", "ecmwf", "era5")
    out = {"ens3_ws100_std": row_std(["era5_wind_speed_100m", "gfs_ws100m", "ecmwf_ws100m"])}
    for s in ("gfs", "ecmwf"):
        rad = F.radians(f"{s}_dir100m")
        out |= {f"{s}_dir100m_sin": F.sin(rad), f"{s}_dir100m_cos": F.cos(rad)}
    return h.withColumns(out)


@query("W07_extended_rolling", _MULTI + "SELECT " + cols({
    **{f"gfs_ws100_roll{n}h_mean": mean("g", n, n // 2) for n in (6, 12, 24)},
    **{f"gfs_ws100_roll{n}h_std": std("g", n, n // 2) for n in (6, 12, 24)}, "gfs_ws100_accel": f"{delta('g', 1)}-{delta('g', 2)}",
    **{f"ecmwf_ws100_roll{n}h_mean": mean("k", n, n // 2) for n in (6, 12)}, "ecmwf_ws100_accel": f"{delta('k', 1)}-{delta('k', 2)}",
    **{f"ens3_spread_roll{n}h_mean": mean("sd", n) for n in (6, 12)}}) + " FROM mm")
def extended_rolling(spark, sf):
    m = multi(spark, sf)
    return added(m, windows.extended_rolling_columns(m))


@query("W08_direction_change", _HD[:-1] + f""", d AS (SELECT site_id, ts, s, c,
   CASE WHEN lag(s) {OVER}) IS NULL THEN acos(least(1.0e0, s*s+c*c)) ELSE acos(least(1.0e0, greatest(-1.0e0, s*lag(s) {OVER})+c*lag(c) {OVER})))) END AS t1,
   coalesce({delta('s', 3)}, 0) AS s3, coalesce({delta('c', 3)}, 0) AS c3 FROM hd) SELECT """ + cols({
    "dir_change_1h": "t1", "dir_change_3h_sin": "s3", "dir_change_3h_cos": "c3", "dir_change_3h_mag": "sqrt(s3*s3+c3*c3)",
    "dir_stability_6h": std("t1", 6)}) + " FROM d")
def direction_change(spark, sf):
    h = weather.direction_columns(hourly(spark, sf))
    return added(h, windows.direction_change_columns(h))


def _inst(n: int) -> str:
    a, b = mean("gs", n, n // 2), mean("gc", n, n // 2)
    return f"1-least(1.0e0, sqrt(pow({a}, 2)+pow({b}, 2)))"


@query("W09_direction_instability", _MULTI + "SELECT " + cols({
    **{f"gfs_dir_instability_{n}h": f"CASE WHEN count(gs) {rows(n)} >= {n // 2} THEN {_inst(n)} END" for n in (12, 24)},
    "gfs_ecmwf_dir_diff": "radians(CASE WHEN abs(gd-kd) <= 180 THEN abs(gd-kd) ELSE 360-abs(gd-kd) END)"}) + " FROM mm")
def direction_instability(spark, sf):
    m = multi(spark, sf)
    return added(m, windows.direction_instability_columns(m))


@query("W10_trends", _MULTI + "SELECT " + cols({f"{p}_trend_{n}h": delta(c, n) for p, c in (
    ("gfs_ws100m", "g"), ("ecmwf_ws100m", "k"), ("ens3_spread", "sd")) for n in (6, 12)}) + " FROM mm")
def trends(spark, sf):
    m = multi(spark, sf)
    return added(m, windows.trend_columns(m, {"gfs_ws100m": "gfs_ws100m", "ecmwf_ws100m": "ecmwf_ws100m", "ens3_ws100_std": "ens3_spread"}))


def _pm(n: int) -> str:
    return f"coalesce(CASE WHEN count(power_mw) {past(n)} >= {n // 2} THEN avg(power_mw) {past(n)} END, 0)"


def _ps(n: int) -> str:
    return f"coalesce(CASE WHEN count(power_mw) {past(n)} >= {n // 2} THEN stddev_samp(power_mw) {past(n)} END, 0)"


@query("W11_power_lags", with_(HOURLY) + "SELECT " + cols({
    **{f"lag_power_{n}h": f"coalesce(lag(power_mw, {n}) {OVER}), 0)" for n in (1, 3, 6, 12, 24)},
    **{f"power_roll{n}h_mean": _pm(n) for n in (6, 12, 24)}, **{f"power_roll{n}h_std": _ps(n) for n in (6, 12)},
    "power_ramp_1h": f"coalesce(lag(power_mw, 1) {OVER})-lag(power_mw, 2) {OVER}), 0)",
    "power_ramp_3h": f"coalesce(lag(power_mw, 1) {OVER})-lag(power_mw, 4) {OVER}), 0)"}) + " FROM hourly")
def power_lags(spark, sf):
    h = hourly(spark, sf)
    return added(h, windows.power_lag_columns(h))


@query("W12_short_lags", with_(HOURLY) + "SELECT " + cols({
    **{f"power_lag{n}h": f"lag(power_mw, {n}) {OVER})" for n in (1, 2, 3, 6)},
    **{f"power_rmean{n}h": f"avg(power_mw) {past(n)}" for n in (3, 6)}}) + " FROM hourly")
def short_lags(spark, sf):
    h = hourly(spark, sf)
    return added(h, windows.short_lag_columns(h))


_SPLIT = "TIMESTAMP '2024-01-21 00:00:00'"


@query("W13_tiered_power", with_(HOURLY, f"""t AS (SELECT *, greatest(0.0e0, least(90.09e0, power_mw+((m%21)-10)*1.2e0*sqrt(((m*29)%2503+0.5e0)/2503.0e0))) AS o,
   greatest(0.0e0, least(90.09e0, power_mw+((m%17)-8)*1.3e0*sqrt(((m*43)%2503+0.5e0)/2503.0e0))) AS s FROM hourly),
   p AS (SELECT *, CASE WHEN ts >= {_SPLIT} THEN s WHEN ts >= TIMESTAMP '2024-01-11 00:00:00' THEN o ELSE power_mw END AS x FROM t)""") + "SELECT " + cols({
    "power_series": "x", "lag_power_1h": f"coalesce(lag(x) {OVER}), 0)"}) + " FROM p")
def tiered(spark, sf):
    h = hourly(spark, sf).withColumns({"_split": F.when(F.col(TS) >= F.lit("2024-01-21").cast("timestamp_ntz"), "valid").otherwise("train")})
    o = oof(spark, sf)
    held = o.filter(F.col(TS) >= F.lit("2024-01-11").cast("timestamp_ntz"))
    scored = o.select(SITE, TS, F.col("pred_mw_mw").alias("pred_mw"))
    t = windows.tiered_power(h, oof=held, scored=scored)
    out = windows.power_lag_columns(t, power="power_series", lags=(1,))
    return out.select(SITE, TS, "power_series", "lag_power_1h")


_RES = with_(HOURLY, """u AS (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-25 23:00:00' AND power_mw <= 90.09e0
   THEN power_mw-7.0e0*wind_speed_120m END AS x FROM hourly)""")


def _residual(spark, sf):
    h = hourly(spark, sf)
    ok = (F.col(TS) <= F.lit("2024-01-25 23:00:00").cast("timestamp_ntz")) & (F.col(TARGET) <= 90.09)
    return h.withColumns({"underprod": F.when(ok, F.col(TARGET) - 7.0 * F.col("wind_speed_120m"))})


_MH = "OVER (PARTITION BY site_id, month(ts), hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("W14_walk_forward", _RES + "SELECT " + cols({"avail_underprod_rate_mh": f"coalesce(avg(x) {_MH}, 0)"},
    {"avail_underprod_count_mh": f"count(x) {_MH}"}) + " FROM u")
def walk_forward(spark, sf):
    u = _residual(spark, sf)
    return added(u, windows.walk_forward_rate(u, value="underprod", chunk_seconds=7 * 86_400))


@query("W15_trailing_mean", _RES + "SELECT " + cols({
    f"avail_underprod_rate_{d}d": f"coalesce(avg(x) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL {d} DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING), 0)"
    for d in (5, 30)}) + " FROM u")
def trailing_mean(spark, sf):
    u = _residual(spark, sf)
    five = windows.trailing_days_mean(u, value="underprod", out="avail_underprod_rate_5d", days=5)
    return added(u, windows.trailing_days_mean(five, value="underprod"))


_FLAG = with_(HOURLY, "f AS (SELECT *, CASE WHEN power_mw < 55 THEN 1 ELSE 0 END AS f FROM hourly)",
   f"s AS (SELECT *, CASE WHEN f = lag(f) {OVER}) THEN 0 ELSE 1 END AS st FROM f)", f"r AS (SELECT *, sum(st) {OVER}) AS run FROM s)",
   "n AS (SELECT *, count(*) OVER (PARTITION BY site_id, run) AS size FROM r)")


def _low(spark, sf):
    h = hourly(spark, sf)
    return h.withColumns({"low": flag(F.col(TARGET) < 55)})


@query("W16_long_runs", _FLAG + "SELECT " + cols({}, {"low": "f", "flagged": "CASE WHEN f = 1 AND size >= 3 THEN 1 ELSE 0 END"}) + " FROM n")
def long_runs(spark, sf):
    return windows.keep_long_runs(_low(spark, sf), flag_col="low").select(SITE, TS, "low", "flagged")


@query("W17_run_statistics", _FLAG + ", q AS (SELECT site_id, run, count(*) AS k FROM n WHERE f = 1 GROUP BY 1, 2) SELECT "
       + cols({"mean_run_rows": "avg(k)"}, {"n_runs": "count(*)", "max_run_rows": "max(k)"}, keys="site_id") + " FROM q GROUP BY site_id")
def run_stats(spark, sf):
    return windows.run_statistics(_low(spark, sf), flag_col="low")


@query("W18_skill_weights", with_(HOURLY, "a AS (SELECT *, abs(power_mw-6*wind_speed_120m) AS e FROM hourly)",
    f"b AS (SELECT *, 1/(coalesce(CASE WHEN count(e) {rows(720)} >= 24 THEN avg(e) {rows(720)} END, avg(e) OVER (PARTITION BY site_id))+1) AS k FROM a)")
    + "SELECT " + cols({"skill_weight": "k/avg(k) OVER (PARTITION BY site_id)"}) + " FROM b")
def skill(spark, sf):
    h = hourly(spark, sf).withColumns({"expected": 6 * F.col("wind_speed_120m")})
    return windows.skill_weights(h, expected="expected").select(SITE, TS, "skill_weight")


@query("W19_autocorrelation", with_(HOURLY, "l AS (" + " UNION ALL ".join(
    f"SELECT site_id, {n} AS lag, power_mw AS x, lag(power_mw, {n}) {OVER}) AS y FROM hourly" for n in (1, 2, 3, 6, 12, 24)) + ")")
    + "SELECT " + cols({"autocorrelation": "corr(x, y)"}, {"lag": "lag"}, keys="site_id") + " FROM l GROUP BY site_id, lag")
def autocorrelation(spark, sf):
    return windows.lag_autocorrelation(hourly(spark, sf))


@query("W20_lookback_sequences", with_(HOURLY) + "SELECT " + cols({
    "power_mw": "power_mw", "oldest_wind": f"lag(wind_speed_120m, 12) {OVER})", "newest_wind": f"lag(wind_speed_120m, 1) {OVER})",
    "sum_wind": f"sum(wind_speed_120m) {past(12)}", "sum_power": f"sum(power_mw) {past(12)}"}, {"n": "12"})
    + f" FROM hourly QUALIFY count(*) {past(12)} = 12")
def lookback(spark, sf):
    s = windows.lookback_sequences(hourly(spark, sf), features=["wind_speed_120m", TARGET])
    total = lambda f: F.aggregate(F.col(f"sequence.{f}"), F.lit(0.0), lambda a, x: a + x)
    return s.select(SITE, TS, TARGET, F.get("sequence", F.lit(0)).wind_speed_120m.alias("oldest_wind"),
                    F.get("sequence", F.lit(11)).wind_speed_120m.alias("newest_wind"), total("wind_speed_120m").alias("sum_wind"),
                    total(TARGET).alias("sum_power"), F.size("sequence").alias("n"))


_DAY = 12


@query("W21_day_sequences", with_(HOURLY) + "SELECT " + cols({
    "first_wind": "arg_min(wind_speed_120m, ts)", "last_wind": "arg_max(wind_speed_120m, ts)", "sum_power": "sum(power_mw)"},
    {"n": "count(*)"}, keys="site_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day")
    + f" FROM hourly GROUP BY site_id, CAST(ts AS DATE) HAVING count(*) = {_DAY} AND count(power_mw) = {_DAY}")
def day_sequences(spark, sf):
    # Days of the derived table have gaps, so the checked query keeps days with 12 rows; the operator's default is 24.
    d = windows.day_sequences(hourly(spark, sf), features=["wind_speed_120m"], rows_per_day=_DAY)
    return d.select(SITE, "day", F.get("sequence", F.lit(0)).wind_speed_120m.alias("first_wind"),
                    F.get("sequence", F.lit(_DAY - 1)).wind_speed_120m.alias("last_wind"),
                    F.aggregate(F.col(f"sequence.{TARGET}"), F.lit(0.0), lambda a, x: a + x).alias("sum_power"), F.size("sequence").alias("n"))


_REGION = "region AS (SELECT CAST(floor(site_id/5.0e0) AS BIGINT) AS site_id, ts, max(wind_speed_120m) AS v, max(power_mw) AS y FROM hourly GROUP BY 1, 2)"


@query("W21_region_day_sequences", with_(HOURLY, _REGION, "o AS (SELECT *, row_number() OVER (PARTITION BY site_id, CAST(ts AS DATE) ORDER BY ts) AS k FROM region)")
    + "SELECT " + cols({"wind_by_place": "sum(k*v)", "power_by_place": "sum(k*y)"}, {"n": "count(*)"}, keys="site_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day")
    + " FROM o GROUP BY site_id, CAST(ts AS DATE) HAVING count(*) = 24 AND count(y) = 24")
def region_day_sequences(spark, sf):
    # Five sites together have an event in nearly every hour, so most of their days are whole.
    regions = hourly(spark, sf).groupBy(F.floor(F.col(SITE) / 5.0).cast("long").alias(SITE), "ts").agg(
        F.max("wind_speed_120m").alias("wind_speed_120m"), F.max(TARGET).alias(TARGET))
    d = windows.day_sequences(regions, features=["wind_speed_120m"])

    def by_place(f: str):
        weighted = F.transform(f"sequence.{f}", lambda x, i: x * (i + 1))
        return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return d.select(SITE, "day", by_place("wind_speed_120m").alias("wind_by_place"), by_place(TARGET).alias("power_by_place"), F.size("sequence").alias("n"))
