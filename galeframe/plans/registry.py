"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is brought to the comparison types."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def tidy(df: DataFrame) -> DataFrame:
    """Times as text, doubles rounded to six decimals, integers and booleans as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp") or kind == "date":
            out.append(c.cast("string").alias(name))
        elif kind in ("double", "float"):
            out.append(F.round(c.cast("double"), 6).alias(name))
        elif kind in ("tinyint", "smallint", "int", "boolean"):
            out.append(c.cast("bigint").alias(name))
        else:
            out.append(c)
    return df.select(*out)
