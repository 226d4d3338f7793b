"""Forecast tables derived from the event and order tables, for tests and checks.

Every row of ``events`` takes part; the number of sites grows with the number
of users, so the work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.config import REPAIR, SITE, TARGET, TS
from galeframe.session import prepare

USERS_PER_SITE = 20

HOURLY_COLUMNS = f"""
  {SITE}, {TS}, m, ws120 AS wind_speed_120m,
  ws120*(0.80e0+(m%17)/100.0e0) AS wind_speed_80m,
  ws120*(0.45e0+(m%29)/100.0e0) AS wind_speed_10m,
  CASE WHEN m%5=0 THEN NULL ELSE ws120*(1.0e0+(m%13)/50.0e0) END AS wind_speed_180m,
  (d+1)/1000.0e0 AS wind_direction_120m,
  ((d+7)%360+1)/1000.0e0 AS wind_direction_80m,
  ((d+19)%360+1)/1000.0e0 AS wind_direction_10m,
  CASE WHEN m%5=0 THEN NULL ELSE ((d+351)%360+1)/1000.0e0 END AS wind_direction_180m,
  ws120*(0.45e0+(m%29)/100.0e0)*(1.2e0+(m%11)/20.0e0) AS wind_gusts_10m,
  (m%350)/10.0e0-8.0e0 AS temperature_80m,
  (m%350)/10.0e0-8.3e0+(m%7)/10.0e0 AS temperature_120m,
  (m%350)/10.0e0-7.1e0-(m%5)/10.0e0 AS temperature_2m,
  995.0e0+(m%400)/10.0e0 AS pressure_msl,
  CASE WHEN m%3=0 THEN (m%19)/8.0e0 ELSE 0.0e0 END AS rain,
  CASE WHEN m%7=0 THEN (m%11)/10.0e0 ELSE 0.0e0 END AS showers,
  CASE WHEN m%11=0 THEN (m%13)/20.0e0 ELSE 0.0e0 END AS snowfall,
  ((m*7)%101)/1.0e0 AS cloud_cover_low,
  {REPAIR},
  CASE WHEN m%997=0 THEN 95.0e0
       ELSE (1.0e0-0.05e0*sqrt(((m*61)%2503+0.5e0)/2503.0e0))
            *least(90.09e0*(26-{REPAIR})/26.0e0, 90.09e0*least(1.0e0,pow(ws120/12.0e0,3.0e0))*(0.70e0+(m%31)/100.0e0)) END AS {TARGET}
"""

# Each feed: minutes its clock runs ahead (so some hours have no partner) and its columns.
FEEDS: dict[str, tuple[int, str]] = {
    "reanalysis": (20, """
      v AS wind_speed_100m, v*(0.60e0+(m%23)/100.0e0) AS wind_speed_10m,
      d*1.0e0+0.5e0 AS wind_direction_100m, ((d+13)%360)*1.0e0+0.5e0 AS wind_direction_10m,
      v*(0.60e0+(m%23)/100.0e0)*(1.3e0+(m%9)/20.0e0) AS wind_gusts_10m,
      (m%340)/10.0e0-7.5e0 AS temperature_2m, 996.0e0+(m%390)/10.0e0 AS pressure_msl,
      (m%97)*1.0e0 AS cloud_cover_low, CASE WHEN m%4=0 THEN (m%17)/9.0e0 ELSE 0.0e0 END AS rain,
      CASE WHEN m%13=0 THEN (m%7)/10.0e0 ELSE 0.0e0 END AS snowfall"""),
    "reanalysis_v2": (22, """
      50.0e0+(m*31)%1900 AS blh, 300.0e0+(m*17)%2500 AS cbh,
      v*1.35e0 AS wind_speed_850hpa, v*1.22e0 AS wind_speed_925hpa,
      (m%60)/20.0e0-0.5e0 AS llj_strength, CASE WHEN m%8=0 THEN 1.0e0 ELSE 0.0e0 END AS is_llj,
      (m*3)%700-20.0e0 AS cape, (m%550)/10.0e0 AS tcwv,
      (m*11)%400-150.0e0 AS sshf, (m*19)%500-300.0e0 AS slhf,
      (m%21)/30.0e0 AS cp, (m%33)/40.0e0 AS lsp,
      270.0e0+(m%310)/10.0e0 AS stl1, 275.0e0+(m%210)/10.0e0 AS stl4,
      0.1e0+(m%37)/100.0e0 AS swvl1, 0.1e0+(m%29)/100.0e0 AS swvl2,
      (m%6)/5.0e0 AS snowc, (m%90)/10.0e0-4.0e0 AS skt_minus_t2m,
      1.15e0+(m%150)/1000.0e0 AS air_density, 0.05e0+(m%40)/100.0e0 AS alpha_10_100,
      v*0.96e0 AS wind_speed_84m, v*1.03e0 AS wind_speed_120m,
      CASE WHEN m%2=0 THEN 1.0e0 ELSE 0.0e0 END AS is_daytime"""),
    "gfs": (25, """
      v AS wind_speed_100m, v*(0.58e0+(m%19)/100.0e0) AS wind_speed_10m,
      d*1.0e0+0.25e0 AS wind_direction_100m, ((d+9)%360)*1.0e0+0.25e0 AS wind_direction_10m,
      v*(0.58e0+(m%19)/100.0e0)*(1.1e0+(m%31)/20.0e0) AS wind_gusts_10m,
      (m%330)/10.0e0-6.5e0 AS temperature_2m, 997.0e0+(m%380)/10.0e0 AS pressure_msl"""),
    "ecmwf": (35, """
      v AS wind_speed_100m, v*(0.62e0+(m%13)/100.0e0) AS wind_speed_10m,
      d*1.0e0+0.75e0 AS wind_direction_100m,
      v*(0.62e0+(m%13)/100.0e0)*(1.15e0+(m%27)/20.0e0) AS wind_gusts_10m,
      (m%320)/10.0e0-6.0e0 AS temperature_2m, 998.0e0+(m%370)/10.0e0 AS pressure_msl"""),
    "icon": (40, """
      v AS wind_speed_100m, v*(0.64e0+(m%11)/100.0e0) AS wind_speed_10m,
      d*1.0e0+0.6e0 AS wind_direction_100m,
      v*(0.64e0+(m%11)/100.0e0)*(1.2e0+(m%25)/20.0e0) AS wind_gusts_10m,
      (m%315)/10.0e0-5.5e0 AS temperature_2m, 999.0e0+(m%365)/10.0e0 AS pressure_msl"""),
    "merra": (15, """
      v*0.93e0 AS ws50m, v*0.71e0 AS ws10m, d*1.0e0+0.1e0 AS wd50m, ((d+5)%360)*1.0e0+0.1e0 AS wd10m,
      (m%325)/10.0e0-7.0e0 AS t2m, 40.0e0+(m%60) AS rh2m, 1000.0e0+(m%300)/10.0e0 AS slp,
      990.0e0+(m%300)/10.0e0 AS ps, 0.01e0+(m%50)/100.0e0 AS z0m, (m%90)/10.0e0 AS disph,
      (m%23)/10.0e0 AS prectotcorr, (m*13)%900*1.0e0 AS allsky_sfc_sw_dwn"""),
    "gem": (10, """
      v*0.7e0 AS wind_speed_10m, v*1.05e0 AS wind_gusts_10m, 1001.0e0+(m%350)/10.0e0 AS pressure_msl"""),
    "icon_global": (50, "v*0.72e0 AS wind_speed_10m"),
    "ai": (30, """
      v AS aifs_wind_speed_100m, d*1.0e0+0.3e0 AS aifs_wind_direction_100m,
      v*0.69e0 AS graphcast_wind_speed_10m, ((d+3)%360)*1.0e0+0.3e0 AS graphcast_wind_direction_10m,
      1000.0e0+(m%360)/10.0e0 AS graphcast_pressure_msl"""),
    "multi": (28, """
      CASE WHEN m%6=0 THEN NULL ELSE v END AS om_wind_speed_100m_ecmwf_ifs025,
      CASE WHEN m%7=0 THEN NULL ELSE v*1.04e0 END AS om_wind_speed_100m_gfs_global,
      CASE WHEN m%9=0 THEN NULL ELSE v*(0.9e0+(m%15)/100.0e0) END AS om_wind_speed_100m_icon_global,
      v*0.97e0 AS om_wind_speed_100m_best_match,
      v*0.66e0 AS om_wind_speed_10m_ecmwf_ifs025, CASE WHEN m%5=0 THEN NULL ELSE v*0.63e0 END AS om_wind_speed_10m_gfs_global,
      v*0.61e0 AS om_wind_speed_10m_icon_global, v*0.65e0 AS om_wind_speed_10m_best_match,
      v*1.1e0 AS om_wind_gusts_10m_ecmwf_ifs025, CASE WHEN m%4=0 THEN NULL ELSE v*1.21e0 END AS om_wind_gusts_10m_gfs_global,
      v*1.14e0 AS om_wind_gusts_10m_icon_global, v*1.18e0 AS om_wind_gusts_10m_best_match,
      d*1.0e0+0.2e0 AS om_wind_direction_100m_ecmwf_ifs025,
      CASE WHEN m%8=0 THEN NULL ELSE ((d+11)%360)*1.0e0+0.2e0 END AS om_wind_direction_100m_gfs_global,
      ((d+352)%360)*1.0e0+0.2e0 AS om_wind_direction_100m_icon_global,
      ((d+4)%360)*1.0e0+0.2e0 AS om_wind_direction_100m_best_match,
      v*0.12e0 AS om_wind_std, v*0.27e0 AS om_wind_range, v*0.95e0 AS om_wind_hub_mean"""),
}

# Multipliers giving every feed its own wind and direction series.
FEED_STEPS = {name: (41 + 2 * i, 59 + 2 * i) for i, name in enumerate(FEEDS)}


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _last_event_per_hour(events: DataFrame, minutes_ahead: int) -> DataFrame:
    shifted = F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes_ahead))
    return events.groupBy(
        F.floor(F.col("user_id") / USERS_PER_SITE).cast("bigint").alias(SITE),
        F.date_trunc("hour", shifted).cast("timestamp_ntz").alias(TS),
    ).agg(F.max("event_id").alias("m"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and hour that has an event: weather, repair count and power."""
    last = _last_event_per_hour(_load(spark, sf_dir, "events"), 0)
    # u in (0, 1); 25*u^1.5 keeps wind irrational, so rounding never meets a tie.
    base = last.selectExpr(SITE, TS, "m", "((m*37)%2500+0.5e0)/2503.0e0 AS u", "(m*53)%360 AS d", f"m%4 AS {REPAIR}")
    wind = base.selectExpr(SITE, TS, "m", "25.0e0*u*sqrt(u) AS ws120", "d", REPAIR)
    return wind.selectExpr(*_split(HOURLY_COLUMNS))


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A weather source keyed by (site, hour)."""
    minutes, cols = FEEDS[name]
    a, b = FEED_STEPS[name]
    last = _last_event_per_hour(_load(spark, sf_dir, "events"), minutes)
    base = last.selectExpr(SITE, TS, "m", f"((m*{a})%2500+0.5e0)/2503.0e0 AS u", f"(m*{b})%360 AS d")
    wind = base.selectExpr(SITE, TS, "m", "25.0e0*u*sqrt(u) AS v", "d")
    return wind.selectExpr(SITE, TS, *_split(cols))


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions: three folds by third of the month."""
    return hourly(spark, sf_dir).selectExpr(
        "CAST(least(5, 3 + floor((day(ts)-1)/10.0e0)) AS BIGINT) AS fold", SITE, TS,
        f"{TARGET} AS target_mw", f"26-{REPAIR} AS active_turbines", "wind_speed_120m AS ws_120",
        f"greatest(0.0e0, least(90.09e0, {TARGET}+((m%21)-10)*1.2e0*sqrt(((m*29)%2503+0.5e0)/2503.0e0))) AS pred_cf_mw",
        f"greatest(0.0e0, least(90.09e0, {TARGET}+((m%17)-8)*1.3e0*sqrt(((m*43)%2503+0.5e0)/2503.0e0))) AS pred_mw_mw",
    )


def oof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions covering every month of several years, from the order table."""
    return _load(spark, sf_dir, "orders").selectExpr(
        "CAST(floor(o_custkey/200.0e0) AS BIGINT) AS site_id", "o_orderkey AS row_id",
        "o_orderdate AS ts", "CAST(year(o_orderdate) AS BIGINT) AS fold", "CAST(month(o_orderdate) AS BIGINT) AS month",
        "90.09e0*sqrt(o_totalprice/600000.0e0) AS y_pred",
        "90.09e0*sqrt(o_totalprice/600000.0e0)*(0.85e0+0.02e0*month(o_orderdate))"
        "+((o_orderkey%23)-11)*0.37e0+0.1e0*month(o_orderdate) AS y_true",
        "25.0e0*sqrt((o_orderkey%1000+0.5e0)/1000.0e0) AS ws_120",
    )


def _split(sql: str) -> list[str]:
    """Split a select list on its top-level commas."""
    out, depth, part = [], 0, ""
    for ch in sql:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    out.append(part.strip())
    return out
