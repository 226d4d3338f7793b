from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [p.strip().split()[0] for p in schema.split(",")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.replace("ts timestamp", "ts timestamp_ntz"))
    return df


def hours(n: int, *, seed: int = 1, sites: dict[int, int] | None = None, gap: float = 0.2, null: float = 0.1) -> list[dict]:
    """Hourly rows with gaps and missing values; ``sites`` maps a site to its number of rows, so one can be hot."""
    rnd, rows = random.Random(seed), []
    for site, size in (sites or {0: n, 1: n // 10}).items():
        t = START
        for _ in range(size):
            t += dt.timedelta(hours=1 if rnd.random() > gap else rnd.randint(2, 90))
            rows.append({"site_id": site, "ts": t, "x": None if rnd.random() < null else rnd.uniform(0, 30), "y": rnd.uniform(0, 90), "f": rnd.random() < 0.6})
    rnd.shuffle(rows)
    return rows


SCHEMA = "site_id long, ts timestamp, x double, y double, f boolean"


def frame(spark: SparkSession, n: int = 300, **kw) -> DataFrame:
    return table(spark, hours(n, **kw), SCHEMA)


def by_site(rows: list[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["site_id"], r["ts"])):
        out.setdefault(r["site_id"], []).append(r)
    return out


def collected(df: DataFrame, *cols: str) -> dict:
    return {(r["site_id"], r["ts"]): tuple(r[c] for c in cols) for r in df.select("site_id", "ts", *cols).collect()}


def near(a, b, tol=1e-9) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


__all__ = ["F"]
