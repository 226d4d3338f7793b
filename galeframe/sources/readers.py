"""Readers for training, scoring and weather tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.config import SITE, TARGET, TS
from galeframe.functions.nullsafe import join_null_safe, nan_to_null
from galeframe.session import prepare

c = F.col


def read_table(spark: SparkSession, path: str, *, fmt: str = "parquet", schema: T.StructType | str | None = None,
               rename: Mapping[str, str] | None = None, site: int | None = None) -> DataFrame:
    """Parquet, CSV, ORC or JSON with an explicit schema, columns renamed to the package's names.

    Header blanks are trimmed and NaN becomes NULL; ``site`` adds the key to a single-site file.
    """
    reader = prepare(spark).read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    names = {n: (rename or {}).get(n.strip(), n.strip()) for n in df.columns}
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    if site is not None:
        df = df.withColumn(SITE, F.lit(site).cast("long"))
    return nan_to_null(df)


def parse_time(df: DataFrame, *, ts: str = TS) -> DataFrame:
    """Text to a zone-free time stamp; unparsable text fails the job, as a broken key must."""
    return df.withColumns({ts: F.to_timestamp_ntz(c(ts))}) if dict(df.dtypes)[ts] == "string" else df


def training_table(df: DataFrame) -> DataFrame:
    """Parsed time and the imputation placeholder; order is left to whoever needs it."""
    df = parse_time(df)
    return df.withColumn("ws_180m_is_imputed", F.lit(False)) if "wind_speed_180m" in df.columns else df


def with_position(df: DataFrame, *, order: Sequence[Column], chunk: Column, descending: bool = False, name: str = "_submission_row") -> DataFrame:
    """Zero-based position in a global order without sorting the table in one task.

    ``chunk`` must be a coarse, order-preserving key (for time order: the hour).
    Rows are numbered inside their chunk; the chunks' sizes give the offsets.
    """
    w_rows = Window.partitionBy("_pos_chunk").orderBy(*order)
    by = c("_pos_chunk").desc() if descending else c("_pos_chunk").asc()
    tagged = df.withColumn("_pos_chunk", chunk)
    sizes = tagged.groupBy("_pos_chunk").agg(F.count(F.lit(1)).alias("_k"))
    # One row per chunk reaches this window, never the rows themselves.
    offsets = sizes.select("_pos_chunk", F.coalesce(
        F.sum("_k").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = tagged.withColumn("_in", F.row_number().over(w_rows) - 1)
    return (join_null_safe(numbered, offsets, ["_pos_chunk"]).withColumn(name, (c("_before") + c("_in")).cast("long"))
            .drop("_pos_chunk", "_before", "_in"))


def scoring_table(df: DataFrame, *, order: Sequence[Column] | None = None) -> DataFrame:
    """Parsed time and the file position; scoring files run from the newest hour to the oldest."""
    df = parse_time(df)
    order = [c(TS).desc(), c(SITE)] if order is None else list(order)
    return with_position(df, order=order, chunk=F.date_trunc("hour", c(TS).cast("timestamp")), descending=True)


def history_and_horizon(df: DataFrame, *, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """Times rounded to the nearest hour (half hours up); rows with a target are history, the rest the horizon."""
    df = parse_time(df)
    nearest = F.date_trunc("hour", c(TS).cast("timestamp") + F.make_dt_interval(mins=F.lit(30))).cast("timestamp_ntz")
    df = df.withColumns({TS: nearest, "ws_180m_is_imputed": F.lit(False)})
    return df.filter(c(target).isNotNull()), df.filter(c(target).isNull())


def keyed_source(df: DataFrame, *, prefix: str, keep: Sequence[str] | None = None, key: str = TS) -> DataFrame:
    """A weather source with its key checked and its columns prefixed."""
    if key not in df.columns:
        raise ValueError(f"source has no {key!r} column")
    names = [n for n in df.columns if n not in (SITE, key) and (keep is None or n in keep)]
    return df.select(SITE, c(key).alias(TS), *[c(n).alias(f"{prefix}{n}") for n in names])


NESTED_HOURS = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))]))])


def hour_key_to_time(key: Column) -> Column:
    """Twelve digits: year month day hour minute; ten: up to the hour; nine: year, day of year, hour."""
    start = F.try_to_timestamp(F.substring(key, 1, 4), F.lit("yyyy"))
    by_day = start + F.make_dt_interval(days=F.substring(key, 5, 3).cast("int") - 1, hours=F.substring(key, 8, 2).cast("int"))
    return (F.when(F.length(key) == 12, F.try_to_timestamp(key, F.lit("yyyyMMddHHmm")))
            .when(F.length(key) == 10, F.try_to_timestamp(key, F.lit("yyyyMMddHH")))
            .when((F.length(key) == 9) & key.rlike("^[0-9]+$"), by_day)).cast("timestamp_ntz")


def tidy_nested_hours(files: DataFrame, parameters: Sequence[str], *, text: str = "text", keys: Sequence[str] = ("file_id",),
                      missing_at: float = -998.0) -> DataFrame:
    """Files of parameter -> hour -> value become one row per (file, hour) with a column per parameter."""
    parsed = files.select(*keys, F.from_json(c(text), NESTED_HOURS).alias("_j"))
    params = parsed.select(*keys, F.explode("_j.properties.parameter").alias("_p", "_hours"))
    cells = params.select(*keys, "_p", F.explode("_hours").alias("_key", "_value"))
    value = F.when(c("_value") > missing_at, c("_value"))
    wide = cells.withColumns({"_value": value, "time": hour_key_to_time(c("_key"))}).groupBy(*keys, "time").agg(
        *[F.max(F.when(c("_p") == p, c("_value"))).alias(p) for p in parameters])
    return wide


def combine(train: DataFrame, score: DataFrame, *, tag: str = "_source") -> DataFrame:
    """Training and scoring rows in one table; columns missing on one side are NULL there."""
    return train.withColumn(tag, F.lit("train")).unionByName(score.withColumn(tag, F.lit("valid")), allowMissingColumns=True)


def split_back(df: DataFrame, *, tag: str = "_source") -> tuple[DataFrame, DataFrame]:
    return df.filter(c(tag) == "train").drop(tag), df.filter(c(tag) == "valid").drop(tag)


def oof_wide(long: DataFrame, *, keys: Sequence[str] = ("fold", SITE, TS, "target_mw", "active_turbines", "ws_120"), kind: str = "target_mode",
             value: str = "raw_pred", kinds: Sequence[str] = ("cf", "mw")) -> DataFrame:
    """Long predictions, one row per target kind, to one row per key."""
    return long.groupBy(*keys).agg(*[F.avg(F.when(c(kind) == k, c(value))).alias(k) for k in kinds])
