import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from galeframe.operators import cleaning, joins, lookups, postprocess, validation
from galeframe.sources import readers, writers
from tests.helpers import collected, frame, hours, table

START = dt.datetime(2023, 1, 1)
CLEAN = "site_id long, ts timestamp, power_mw double, n_repair int, wind_speed_10m double, wind_speed_80m double, wind_speed_120m double, wind_speed_180m double, wind_gusts_10m double"


def clean(spark, n=5, **changes):
    rows = [{"site_id": 0, "ts": START + dt.timedelta(hours=i), "power_mw": 10.0, "n_repair": 0, "wind_speed_10m": 8.0, "wind_speed_80m": 10.0,
             "wind_speed_120m": 11.0, "wind_speed_180m": 12.0, "wind_gusts_10m": 15.0} for i in range(n)]
    for i, fields in changes.items():
        rows[int(i[1:])] |= fields
    return table(spark, rows, CLEAN)


def reasons(df):
    return [r["impossible_reason"] for r in cleaning.impossible_reasons(df).orderBy("ts").collect()]


def test_reasons_and_priority(spark):
    assert reasons(clean(spark)) == [""] * 5
    assert reasons(clean(spark, _2={"power_mw": 91.09}))[2] == "over_capacity"
    assert reasons(clean(spark, _1={"n_repair": 24, "power_mw": 0.5}))[1] == "maintenance_zero"
    both = clean(spark, _0={"power_mw": 95.0, "wind_speed_10m": 1.0, "wind_speed_80m": 1.0, "wind_speed_120m": 1.0, "wind_gusts_10m": 2.0})
    assert reasons(both)[0] == "over_capacity"
    assert reasons(clean(spark, _3={"wind_speed_120m": None, "power_mw": None})) == [""] * 5


def test_weights_guard_and_header(spark):
    df = clean(spark, _2={"power_mw": 91.09})
    weights = [r["weight"] for r in cleaning.training_weights(df, year=2023, year_factor=0.7).orderBy("ts").collect()]
    assert weights == [0.7, 0.7, 0.0, 0.7, 0.7]
    guard = cleaning.rule_guard(df, limit=0.5).first()
    assert (guard["n_rows"], guard["n_flagged"], guard["allowed_share"], guard["within_limit"]) == (5, 1, 0.5, True)
    assert not cleaning.rule_guard(df).first()["within_limit"]  # one limit, whatever the number of rows
    wild = clean(spark, **{f"_{i}": {"power_mw": 95.0} for i in range(4)})
    with pytest.raises(cleaning.CleanerSanityError, match="over_capacity=4"):
        cleaning.require_sane_rules(wild)
    audited = cleaning.training_weights(df)
    head = writers.outlier_audit_header(audited, year_factor=1.0).first()["header"]
    assert "total_excluded=1" in head and "over_capacity: 1" in head and "imputed_180m_pct=n/a" in head
    row = writers.outlier_audit(audited).first()
    assert (row["timestamp"], row["reason"], row["weight"], row["target_value"]) == ("2023-01-01T02:00:00", "over_capacity", "0.000000", "91.090000")


def test_disagreement_keeps_rows_and_missing_is_false(spark):
    df = clean(spark).withColumn("era5_wind_speed_100m", F.when(F.hour("ts") == 0, F.lit(5.9)).when(F.hour("ts") == 1, F.lit(6.0)))
    flags = [r["nwp_era5_disagreement"] for r in cleaning.disagreement_flag(df).orderBy("ts").collect()]
    assert flags == [1, 0, 0, 0, 0]
    assert cleaning.disagreement_flag(clean(spark)).agg(F.sum("nwp_era5_disagreement")).first()[0] == 0


def test_imputation_flag(spark):
    before = clean(spark, _1={"wind_speed_180m": None}, _3={"wind_speed_180m": None})
    after = before.withColumn("wind_speed_180m", F.when(F.hour("ts") == 1, 12.5).otherwise(F.col("wind_speed_180m")))
    got = [r["ws_180m_is_imputed"] for r in cleaning.imputation_flag_between(before, after).orderBy("ts").collect()]
    assert got == [False, True, False, False, False]
    with pytest.raises(KeyError):
        cleaning.imputation_flag(before, "wind_speed_180m", "absent", out="f")


def checks(df, rules):
    return sorted((r["column_name"], r["check_name"]) for r in validation.failing_cells(df, rules).collect())


def test_training_rules(spark):
    assert checks(clean(spark), validation.TRAINING_RULES) == []
    assert checks(clean(spark, _1={"power_mw": 91.0}), validation.TRAINING_RULES) == [("power_mw", "in_range")]
    twice = clean(spark).unionByName(clean(spark).limit(1))
    assert checks(twice, validation.TRAINING_RULES) == [("ts", "field_uniqueness")] * 2
    worst = validation.with_severity(validation.failing_cells(clean(spark, _1={"power_mw": 91.0}, _2={"power_mw": -1.0}), validation.TRAINING_RULES))
    assert sorted(r["severity"] for r in worst.collect()) == ["fatal", "warning"]


def test_weather_and_output_rules(spark):
    assert checks(clean(spark), validation.WEATHER_RULES) == []
    bad = clean(spark, _0={"wind_gusts_10m": 7.0}, _1={"wind_speed_80m": None}, _2={"wind_speed_10m": -1.0})
    assert checks(bad, validation.WEATHER_RULES) == [("<dataframe>", "gust_ge_ws_10m"), ("wind_speed_10m", "in_range"), ("wind_speed_80m", "not_nullable")]
    assert ("<dataframe>", "row_count") in checks(clean(spark), validation.output_rules())
    assert checks(clean(spark, 24), validation.output_rules()) == []
    report = validation.validation_report(bad, validation.WEATHER_RULES, limit=2).first()
    assert (report["n_failures"], report["n_listed"], report["failure_cases_truncated"], report["status"], report["n_rows"]) == (3, 2, True, "warning", 5)


def predictions(spark, n=24, **changes):
    df = clean(spark, n, **changes).select("site_id", "ts", F.col("power_mw").alias("pred_mw"), "wind_speed_120m")
    return readers.with_position(df, order=[F.col("ts")], chunk=F.date_trunc("hour", F.col("ts").cast("timestamp")))


def test_publish_moves_only_good_forecasts(spark, tmp_path):
    path = str(tmp_path / "forecast")
    writers.publish_forecast(predictions(spark), path, expected_rows=24)
    assert spark.read.parquet(path).count() == 24 and not os.path.exists(path + ".stage")
    calm = predictions(spark, _3={"wind_speed_120m": 0.5})
    other = str(tmp_path / "other")
    with pytest.raises(validation.GateError, match="wind_sanity=1"):
        writers.publish_forecast(calm, other, expected_rows=24)
    assert not os.path.exists(other) and os.path.exists(other + ".stage")
    with pytest.raises(validation.GateError, match="row_count"):
        writers.publish_forecast(predictions(spark), other, expected_rows=23)


def test_export_keeps_submission_order(spark, tmp_path):
    scored = readers.scoring_table(clean(spark, 30).select("site_id", "ts", F.hour("ts").cast("double").alias("pred_mw")))
    rows = scored.orderBy("_submission_row").collect()
    assert [r["_submission_row"] for r in rows] == list(range(30))
    assert [r["ts"] for r in rows] == sorted((r["ts"] for r in rows), reverse=True)
    writers.write_in_order(writers.forecast_export(scored, pred="pred_mw"), str(tmp_path / "csv"), order=["_submission_row"], partitions=3)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 30


def test_reader_renames_trims_and_drops_nan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Time , wind\n2024-01-01 00:10:00,1.5\n2024-01-01 01:40:00,NaN\n")
    df = readers.read_table(spark, str(tmp_path / "t.csv"), fmt="csv", schema="a string, b double", rename={"a": "ts", "b": "power_mw"}, site=7)
    past, ahead = readers.history_and_horizon(df)
    assert [(r["site_id"], r["ts"], r["power_mw"]) for r in past.collect()] == [(7, dt.datetime(2024, 1, 1, 0), 1.5)]
    assert [r["ts"] for r in ahead.collect()] == [dt.datetime(2024, 1, 1, 2)]


def test_hour_keys(spark):
    df = spark.createDataFrame([("202402290530",), ("2024022905",), ("202406005",), ("x",)], "k string")
    got = [r["t"] for r in df.select(readers.hour_key_to_time(F.col("k")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 2, 29, 5, 30), dt.datetime(2024, 2, 29, 5), dt.datetime(2024, 2, 29, 5), None]


def test_joins_check_keys_and_coverage(spark):
    df = clean(spark)
    with pytest.raises(joins.DuplicateKeyError):
        joins.require_unique_key(df.unionByName(df))
    assert joins.require_unique_key(df) is df
    half = df.limit(2).select("site_id", "ts", F.lit(1.0).alias("v"))
    with pytest.raises(joins.CoverageError):
        joins.join_with_coverage(df, half)
    assert joins.join_with_coverage(df, half, at_least=0.4).count() == 5


def test_hot_duplicate_key_keeps_the_last(spark):
    df = spark.range(5_000).selectExpr("CASE WHEN id < 4000 THEN 0L ELSE id END AS site_id", "timestamp_ntz'2024-01-01' AS ts", "id AS version")
    got = {r["site_id"]: r["version"] for r in joins.last_by_key(df, order="version").collect()}
    assert len(got) == 1_001 and got[0] == 3_999


def test_folds_do_not_overlap(spark):
    df = table(spark, [{"site_id": 0, "ts": dt.datetime(2022, 1, 1) + dt.timedelta(hours=6 * i)} for i in range(4 * 365 * 4)], "site_id long, ts timestamp")
    out = joins.assign_folds(df, joins.DEFAULT_FOLDS, embargo_hours=24)
    spans = {(r["fold_name"], r["role"]): (r["lo"], r["hi"]) for r in out.groupBy("fold_name", "role").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    for name, _, val_start, val_end in joins.DEFAULT_FOLDS:
        start = dt.datetime.fromisoformat(val_start)
        assert spans[(name, "train")][1] <= start - dt.timedelta(hours=24)
        assert spans[(name, "val")][0] >= start and spans[(name, "val")][1] <= dt.datetime.fromisoformat(val_end)
    with pytest.raises(ValueError):
        joins.assign_folds(df, [("x", "2023-02-01 00:00:00", "2023-01-01 00:00:00", "2023-03-01 00:00:00")])


def test_month_affine_recovers_and_falls_back(spark):
    rows = [(m, float(i % 60), (0.9 + 0.01 * m) * (i % 60) + 0.1 * m) for m in range(1, 13) for i in range(250 if m != 7 else 50)]
    df = spark.createDataFrame(rows, "month long, pred double, y double")
    fit = {r["month"]: (r["slope"], r["offset"]) for r in postprocess.fit_month_affine(df, pred="pred", target="y").collect()}
    for m in range(1, 13):
        want = (1.0, 0.0) if m == 7 else (0.9 + 0.01 * m, 0.1 * m)
        assert abs(fit[m][0] - want[0]) < 1e-9 and abs(fit[m][1] - want[1]) < 1e-6
    steep = spark.createDataFrame([(1, float(i), 3.0 * i) for i in range(300)], "month long, pred double, y double")
    assert tuple(postprocess.fit_month_affine(steep, pred="pred", target="y").select("slope", "offset").first()) == (1.0, 0.0)


def test_later_targets_do_not_leak(spark):
    rows = hours(300, seed=8)
    end = sorted(r["ts"] for r in rows if r["site_id"] == 0)[200]
    cols = ("avail_p_expected_mw", "avail_underprod_mw", "avail_underprod_rate_mh", "avail_underprod_count_mh", "avail_underprod_rate_30d")

    def run(df):
        named = df.withColumnsRenamed({"x": "wind_speed_120m", "y": "power_mw"})
        return collected(lookups.walk_forward_availability(named, train_end=end, freeze_after=end), *cols)
    df = frame(spark, 300, seed=8)
    changed = df.withColumn("y", F.when(F.col("ts") > F.lit(end).cast("timestamp_ntz"), F.lit(89.0)).otherwise(F.col("y")))
    assert run(df) == run(changed)


def test_leave_fold_out_ignores_the_own_fold(spark):
    df = frame(spark, 300, seed=20).select("site_id", "ts", F.col("y").alias("target_mw"), F.col("x").alias("ws_120"), (F.dayofmonth("ts") % 3).cast("long").alias("fold"))
    df = df.withColumn("pred_cf_mw", F.col("target_mw") * 0.9).filter("ws_120 IS NOT NULL")
    other = df.withColumn("target_mw", F.when(F.col("fold") == 1, 0.0).otherwise(F.col("target_mw")))
    a = collected(postprocess.shrunken_bias_correction(df, pred="pred_cf_mw", target="target_mw").filter("fold = 1"), "corrected_mw")
    b = collected(postprocess.shrunken_bias_correction(other, pred="pred_cf_mw", target="target_mw").filter("fold = 1"), "corrected_mw")
    assert a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-9 for k in a)
