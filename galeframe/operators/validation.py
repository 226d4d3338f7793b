"""Table rules and publish gates; every check returns rows, not log lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import CAPACITY_MW, DEFAULT, REPAIR, SITE, TARGET, TOTAL_TURBINES, TS, FarmConfig
from galeframe.operators.ranks import percentiles
from galeframe.operators.settle import settle

c = F.col

# Physical limits of wind (m/s) and temperature (Celsius), and the listed-failure limit.
WIND_RANGE = (0.0, 60.0)
TEMP_RANGE = (-40.0, 50.0)
MAX_LISTED_FAILURES = 1_000


@dataclass(frozen=True)
class Rule:
    column: str
    low: float | None = None
    high: float | None = None
    nullable: bool = True
    required: bool = True


@dataclass(frozen=True)
class TableRules:
    rules: tuple[Rule, ...]
    unique: tuple[str, ...] = ()
    gust_above_mean: bool = False
    row_counts: tuple[int, ...] = ()


def _wind(name: str, nullable: bool = False) -> Rule:
    return Rule(name, *WIND_RANGE, nullable=nullable)


TRAINING_RULES = TableRules(
    (Rule(TS, nullable=False), Rule(TARGET, 0.0, CAPACITY_MW), Rule(REPAIR, 0, TOTAL_TURBINES, nullable=False)), unique=(SITE, TS))
WEATHER_RULES = TableRules(
    (_wind("wind_speed_10m"), _wind("wind_speed_80m"), _wind("wind_speed_120m"), _wind("wind_speed_180m", True),
     _wind("wind_gusts_10m", True), Rule("temperature_2m", *TEMP_RANGE)), gust_above_mean=True)
FORECAST_RULES = TableRules((*WEATHER_RULES.rules, Rule("lead_hour", nullable=False, required=False)), gust_above_mean=True)


def output_rules(row_counts: Sequence[int] = (2126, 24), cfg: FarmConfig = DEFAULT, target: str = TARGET) -> TableRules:
    return TableRules((Rule(TS, nullable=False), Rule(target, 0.0, cfg.capacity_mw, nullable=False)), unique=(SITE, TS),
                      row_counts=tuple(row_counts))


def missing_columns(df: DataFrame, rules: TableRules) -> list[str]:
    return [r.column for r in rules.rules if r.required and r.column not in df.columns]


def failing_cells(df: DataFrame, rules: TableRules) -> DataFrame:
    """One row per failing cell: keys, column, check and value.

    Range and NULL rules run in one pass; uniqueness adds one aggregation.
    Whole-table checks carry no key.
    """
    tests: list[Column] = []

    def add(cond: Column, column: str, check: str, value: Column) -> None:
        tests.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(column).alias("column_name"), F.lit(check).alias("check_name"), value.cast("double").alias("failure_value"))))

    nothing = F.lit(None)
    for r in rules.rules:
        if r.column not in df.columns:
            continue
        if not r.nullable:
            add(c(r.column).isNull(), r.column, "not_nullable", nothing)
        if r.low is not None:
            add((c(r.column) < r.low) | (c(r.column) > r.high), r.column, "in_range", c(r.column))
    if rules.gust_above_mean and {"wind_gusts_10m", "wind_speed_10m"} <= set(df.columns):
        add(gust_below_mean(), "<dataframe>", "gust_ge_ws_10m", c("wind_gusts_10m"))
    keys = [c(SITE), c(TS).cast("string").alias(TS)]
    fields = [c("_t.column_name").alias("column_name"), c("_t.check_name").alias("check_name"), c("_t.failure_value").alias("failure_value")]
    out = df.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("_t")).select(SITE, TS, *fields)
    if rules.unique:
        again = settle(df.groupBy(*rules.unique).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
        rows = df.select(*rules.unique).join(again, list(rules.unique), "left_semi")
        out = out.unionByName(rows.select(*keys, F.lit(rules.unique[-1]).alias("column_name"),
                                          F.lit("field_uniqueness").alias("check_name"), F.lit(None).cast("double").alias("failure_value")))
    if rules.row_counts:
        size = df.agg(F.count(F.lit(1)).alias("_n")).filter(~c("_n").isin(*rules.row_counts))
        out = out.unionByName(size.select(F.lit(None).cast("long").alias(SITE), F.lit(None).cast("string").alias(TS),
                                          F.lit("<dataframe>").alias("column_name"), F.lit("row_count").alias("check_name"),
                                          c("_n").cast("double").alias("failure_value")))
    return out


def gust_below_mean() -> Column:
    """Both present and the gust under the mean wind."""
    return c("wind_gusts_10m") < c("wind_speed_10m")


def with_severity(cells: DataFrame, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Fatal: repeated time stamps and targets above capacity; everything else is a warning."""
    fatal = ((c("column_name") == TS) & (c("check_name") == "field_uniqueness")) | (
        (c("column_name") == TARGET) & (c("check_name") == "in_range") & (c("failure_value") > cfg.capacity_mw))
    return cells.withColumns({"severity": F.when(F.coalesce(fatal, F.lit(False)), "fatal").otherwise("warning")})


def warning_counts(cells: DataFrame, *, suppress: Sequence[str] = ()) -> DataFrame:
    """One row per (column, check) with its number of failing cells."""
    rows = cells.filter(~c("column_name").isin(*suppress)) if suppress else cells
    return rows.groupBy("column_name", "check_name").agg(F.count(F.lit(1)).alias("n_cells"))


def listed_failures(cells: DataFrame, *, limit: int = MAX_LISTED_FAILURES) -> DataFrame:
    """The first failing cells in a fixed order, for a person to read; the whole list is ``cells``."""
    return cells.orderBy("column_name", "check_name", SITE, TS).limit(limit)


def validation_report(df: DataFrame, rules: TableRules, *, limit: int = MAX_LISTED_FAILURES, failures_path: str | None = None) -> DataFrame:
    """One row: status, counts over every failure, the first ``limit`` failures and where all of them are.

    All failing cells are written as a table to ``failures_path`` when it is given.
    """
    cells = with_severity(failing_cells(df, rules))
    if failures_path is not None:
        cells.write.mode("overwrite").parquet(failures_path)
        cells = df.sparkSession.read.schema(cells.schema).parquet(failures_path)
    totals = cells.agg(F.count(F.lit(1)).alias("n_failures"), F.count_if(c("severity") == "fatal").alias("n_fatal"))
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    summary = totals.withColumns({
        "n_rows": n_rows, "failure_cases_truncated": c("n_failures") > limit,
        "status": F.when(c("n_fatal") > 0, "fatal").when(c("n_failures") > 0, "warning").otherwise("ok")})
    cases = listed_failures(cells, limit=limit).agg(F.count(F.lit(1)).alias("n_listed"), F.collect_list(F.to_json(F.struct("*"))).alias("failure_cases"))
    return summary.withColumns({"failures_path": F.lit(failures_path), "n_listed": cases.select("n_listed").scalar(), "failure_cases": cases.select("failure_cases").scalar()})


# --- publish gates: each returns the offending rows ---------------------------------------------

class GateError(ValueError):
    pass


def gate_range(df: DataFrame, *, pred: str = "pred_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    return df.filter(c(pred).isNull() | (c(pred) < 0.0) | (c(pred) > cfg.capacity_mw))


def gate_row_count(df: DataFrame, *, expected: int, allowed: Sequence[int] | None = None) -> DataFrame:
    """A row with the counts when they differ or when ``expected`` is not an allowed size."""
    odd = allowed is not None and expected not in set(allowed)
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"expected_rows": F.lit(expected).cast("long")})
    return out if odd else out.filter(c("n_rows") != c("expected_rows"))


def gate_duplicates(df: DataFrame, *, order: str, keys: Sequence[str] = (SITE, TS)) -> DataFrame:
    """Later copies of a repeated key: everything after its first row in ``order``."""
    first = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).filter("_n > 1")
    first = settle(first)
    return df.join(first, list(keys), "inner").filter(c(order) > c("_first")).drop("_n", "_first")


def gate_wind_sanity(df: DataFrame, *, pred: str = "pred_mw", wind: str = "wind_speed_120m") -> DataFrame:
    return df.filter(((c(wind) < 1.0) & (c(pred) >= 2.0)) | ((c(wind) > 25.0) & (c(pred) >= 5.0)))


def gate_high_percentile(df: DataFrame, *, pred: str = "pred_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Exact 95th percentile and whether it stays within capacity."""
    return percentiles(df, [], pred, {"pct95": 0.95}, width=0.05).withColumns({"within_limit": c("pct95") <= cfg.capacity_mw})


# Lower edges of the wind bins of the monotonicity gate.
GATE_EDGES = (4.0, 6.0, 8.0, 10.0, 12.0)


def gate_bin_medians(df: DataFrame, *, pred: str = "pred_mw", wind: str = "wind_speed_120m") -> DataFrame:
    """Exact median by wind bin; empty bins are absent."""
    idx = F.when(c(wind) >= GATE_EDGES[0], sum(((c(wind) >= e).cast("int") for e in GATE_EDGES[1:]), F.lit(0)))
    rows = df.withColumn("wind_bin", idx).filter(c("wind_bin").isNotNull())
    return percentiles(rows, ["wind_bin"], pred, {"median_mw": 0.5}, width=0.05)


def gate_monotonic(df: DataFrame, *, pred: str = "pred_mw", wind: str = "wind_speed_120m") -> DataFrame:
    """Bins whose median is below that of the nearest lower populated bin (at most five rows reach the window)."""
    from pyspark.sql import Window

    w = Window.orderBy("wind_bin")
    med = gate_bin_medians(df, pred=pred, wind=wind)
    return med.withColumn("previous_mw", F.lag("median_mw").over(w)).filter(c("median_mw") < c("previous_mw"))


def gate_results(df: DataFrame, *, expected: int, order: str, pred: str = "pred_mw", wind: str | None = "wind_speed_120m",
                 allowed: Sequence[int] | None = None, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """One row per gate with the number of violations."""
    gates = {
        "range": gate_range(df, pred=pred, cfg=cfg), "row_count": gate_row_count(df, expected=expected, allowed=allowed),
        "duplicate_timestamp": gate_duplicates(df, order=order),
    }
    if wind is not None:
        gates |= {"wind_sanity": gate_wind_sanity(df, pred=pred, wind=wind),
                  "pct95_capacity": gate_high_percentile(df, pred=pred, cfg=cfg).filter(~c("within_limit")),
                  "wind_monotonicity": gate_monotonic(df, pred=pred, wind=wind)}
    out = None
    for name, bad in gates.items():
        one = bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("gate"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out
