"""Input frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.config import SITE, TS
from galeframe.operators import weather
from galeframe.sources.derived import feed, hourly


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows with active turbines, air density and density-corrected wind."""
    df = weather.availability_columns(hourly(spark, sf)).drop("maintenance_ratio")
    return weather.density_wind_columns(df).drop("wpd_120m", "v_eff_cube")


def prefixed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(SITE, TS, *[F.col(a).alias(b) for a, b in names.items()])


def joined(df: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        df = df.join(o, [SITE, TS], "left")
    return df


def only(df: DataFrame, *names: str) -> DataFrame:
    return df.select(SITE, TS, *names)


def added(before: DataFrame, after: DataFrame, *drop: str) -> DataFrame:
    """Keys plus the columns an operator added."""
    old = set(before.columns) | set(drop)
    return after.select(SITE, TS, *[c for c in after.columns if c not in old])


GFS = {"wind_speed_100m": "gfs_ws100m", "wind_speed_10m": "gfs_ws10m", "wind_direction_100m": "gfs_dir100m",
       "wind_gusts_10m": "gfs_gust10m", "temperature_2m": "gfs_t2m", "pressure_msl": "gfs_msl"}
ECMWF = {"wind_speed_100m": "ecmwf_ws100m", "wind_speed_10m": "ecmwf_ws10m", "wind_direction_100m": "ecmwf_dir100m",
         "wind_gusts_10m": "ecmwf_gust10m", "temperature_2m": "ecmwf_t2m", "pressure_msl": "ecmwf_msl"}
ICON = {"wind_speed_100m": "icon_ws100m", "wind_speed_10m": "icon_ws10m", "wind_direction_100m": "icon_dir100m",
        "wind_gusts_10m": "icon_gusts10m", "temperature_2m": "icon_t2m", "pressure_msl": "icon_msl"}
ERA5 = {n: f"era5_{n}" for n in (
    "wind_speed_10m", "wind_speed_100m", "wind_direction_10m", "wind_direction_100m", "wind_gusts_10m",
    "temperature_2m", "pressure_msl", "cloud_cover_low", "rain", "snowfall")}
MERRA = {n: f"nasa_{n}" for n in ("ws50m", "ws10m", "wd50m", "wd10m", "t2m", "rh2m", "slp", "ps", "z0m", "disph")}


def with_feed(spark: SparkSession, sf: str, df: DataFrame, *names: str) -> DataFrame:
    tables = {"gfs": ("gfs", GFS), "ecmwf": ("ecmwf", ECMWF), "icon": ("icon", ICON), "era5": ("reanalysis", ERA5),
              "nasa": ("merra", MERRA)}
    for n in names:
        if n == "era5v2":
            v2 = feed(spark, sf, "reanalysis_v2")
            df = joined(df, prefixed(v2, {c: f"era5v2_{c}" for c in v2.columns if c not in (SITE, TS)}))
        else:
            table, mapping = tables[n]
            df = joined(df, prefixed(feed(spark, sf, table), mapping))
    return df
