"""Audit tables, exports and the gated publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import DEFAULT, REPAIR, SITE, TARGET, TS, FarmConfig
from galeframe.functions.nullsafe import clip
from galeframe.operators.cleaning import REASONS
from galeframe.operators.validation import GateError, failing_cells, gate_results, output_rules

c = F.col


def six_decimals(x: str | Column) -> Column:
    x = c(x) if isinstance(x, str) else x
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string("%.6f", x.cast("double")))


def iso_time(ts: str = TS) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def outlier_audit(df: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Rows whose weight is not 1, as fixed text columns; needs ``weight`` and ``impossible_reason``."""
    return df.filter(c("weight") != 1.0).select(
        SITE, iso_time().alias("timestamp"), c("impossible_reason").alias("reason"), six_decimals("weight").alias("weight"),
        six_decimals("wind_speed_120m").alias("wind_speed_120m"),
        (cfg.total_turbines - F.coalesce(c(REPAIR), F.lit(0))).cast("int").alias("active_turbines"),
        six_decimals(TARGET).alias("target_value"))


def outlier_audit_header(df: DataFrame, *, year_factor: float | None = None) -> DataFrame:
    """Totals of an audit in one row, and the comment line written above it."""
    imputed = F.avg(c("ws_180m_is_imputed").cast("int")) * 100.0 if "ws_180m_is_imputed" in df.columns else F.lit(None).cast("double")
    out = df.agg(F.count_if(c("weight") != 1.0).alias("total_excluded"), imputed.alias("imputed_180m_pct"),
                 *[F.count_if(c("impossible_reason") == r).alias(f"n_{r}") for r in REASONS])
    reasons = F.concat_ws(", ", *[F.concat(F.lit(f"{r}: "), c(f"n_{r}")) for r in REASONS])
    factor = "n/a" if year_factor is None else f"{year_factor:.6f}"
    line = F.concat(F.lit(f"# downweight_2022={factor} total_excluded="), c("total_excluded"), F.lit(" reasons={"), reasons,
                    F.lit("} imputed_180m_pct="), F.when(c("imputed_180m_pct").isNull(), F.lit("n/a")).otherwise(F.format_string("%.1f", c("imputed_180m_pct"))))
    return out.withColumns({"header": line})


def residual_audit(flagged: DataFrame) -> DataFrame:
    """Flagged residuals as fixed text columns."""
    return flagged.filter(c("residual_flag") == 1).select(
        SITE, iso_time().alias("timestamp"), six_decimals(TARGET).alias("y"), six_decimals("y_oof").alias("y_oof"),
        six_decimals("residual").alias("residual"), six_decimals("wind_speed_120m").alias("ws_120m"), "ws_bin",
        six_decimals("threshold").alias("threshold"), F.lit("True").alias("flagged"))


def forecast_export(df: DataFrame, *, pred: str, row: str = "_submission_row", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """One text column in submission order; the position stays beside it so any writer can sort."""
    return df.select(row, six_decimals(clip(pred, 0.0, cfg.capacity_mw)).alias("value"))


def write_in_order(df: DataFrame, path: str, *, order: list[str], fmt: str = "csv", partitions: int = 64) -> None:
    """Range-partitioned, sorted files: reading them in name order restores the order."""
    out = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def publish_forecast(df: DataFrame, path: str, *, expected_rows: int, pred: str = "pred_mw", wind: str | None = "wind_speed_120m",
                     order: str = "_submission_row", cfg: FarmConfig = DEFAULT, allowed_rows: tuple[int, ...] | None = None) -> str:
    """Clip, validate, write to a staging folder, run the gates on what was written, then move it into place.

    A failed check raises and leaves the staged files for inspection; ``path`` is only touched at the end.
    """
    spark = df.sparkSession
    clipped = df.withColumns({pred: clip(pred, 0.0, cfg.capacity_mw)})
    keep = [SITE, TS, order, pred, *([wind] if wind else [])]
    bad = failing_cells(clipped, output_rules((expected_rows,), cfg, pred)).limit(1).collect()
    if bad:
        raise GateError(f"forecast table fails {bad[0]['check_name']} on {bad[0]['column_name']}")
    stage = f"{path.rstrip('/')}.stage"
    clipped.select(*keep).write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    failed = gate_results(staged, expected=expected_rows, order=order, pred=pred, wind=wind, allowed=allowed_rows, cfg=cfg
                          ).filter("n_violations > 0").collect()
    if failed:
        raise GateError("gates failed, staged files kept: " + ", ".join(f"{r['gate']}={r['n_violations']}" for r in failed))
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.before")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not (fs.delete(aside, True) or not fs.exists(aside)):
        raise OSError(f"could not clear {path}.before")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        fs.rename(aside, target)
        raise OSError(f"could not move {stage} to {path}; the former forecast stays")
    fs.delete(aside, True)
    return path
