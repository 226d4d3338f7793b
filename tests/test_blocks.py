import datetime as dt
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from galeframe.operators import windows
from galeframe.operators.blocks import lag, lead, roll_mean, roll_std, run_blocked, with_row_number
from tests.helpers import by_site, collected, frame, hours, near


@pytest.mark.parametrize("chunk", [3_600 * 5, 86_400 * 60])
def test_row_number_is_global_per_site(spark, chunk):
    rows = hours(200)
    got = {(r["site_id"], r["ts"]): r["_row"] for r in with_row_number(frame(spark, 200), chunk_seconds=chunk).collect()}
    for site, part in by_site(rows).items():
        assert [got[(site, r["ts"])] for r in part] == list(range(len(part)))


@pytest.mark.parametrize("block_rows", [3, 7, 1000])
def test_blocked_frames_equal_whole_site_windows(spark, block_rows):
    df = frame(spark, 250)

    def build(w):
        return [{"m": roll_mean("x", 12, w), "s": roll_std("x", 12, w, 6), "l": lag("x", 5, w), "a": lead("x", 4, w)}, {"mm": F.avg("m").over(w.rowsBetween(-2, 0))}]
    blocked = run_blocked(df, build, back=11 + 2, ahead=4, block_rows=block_rows)
    whole = df
    for group in build(Window.partitionBy("site_id").orderBy("ts")):
        whole = whole.withColumns(group)
    a, b = collected(blocked, "m", "s", "l", "a", "mm"), collected(whole, "m", "s", "l", "a", "mm")
    assert a.keys() == b.keys()
    assert all(near(x, y) for k in a for x, y in zip(a[k], b[k]))


def test_input_order_does_not_matter(spark):
    df = frame(spark, 120)
    a = collected(windows.power_lag_columns(df.orderBy("y"), power="y"), "lag_power_3h", "power_roll12h_mean", "power_ramp_3h")
    b = collected(windows.power_lag_columns(df.repartition(7), power="y"), "lag_power_3h", "power_roll12h_mean", "power_ramp_3h")
    assert a == b


def test_long_runs_against_counting(spark):
    rows = hours(300, seed=5)
    got = collected(windows.keep_long_runs(frame(spark, 300, seed=5), flag_col="f", min_rows=3), "flagged")
    lengths = {}
    for site, part in by_site(rows).items():
        i = 0
        while i < len(part):
            j = i
            while j < len(part) and part[j]["f"] == part[i]["f"]:
                j += 1
            for r in part[i:j]:
                assert got[(site, r["ts"])][0] == (part[i]["f"] and j - i >= 3)
            if part[i]["f"]:
                lengths.setdefault(site, []).append(j - i)
            i = j
    stats = {r["site_id"]: r for r in windows.run_statistics(frame(spark, 300, seed=5), flag_col="f").collect()}
    for site, sizes in lengths.items():
        assert stats[site]["n_runs"] == len(sizes) and stats[site]["max_run_rows"] == max(sizes)
        assert near(stats[site]["mean_run_rows"], statistics.mean(sizes))


def test_walk_forward_uses_only_the_past(spark):
    rows = hours(400, seed=3, gap=0.1)
    df = frame(spark, 400, seed=3, gap=0.1)
    got = collected(windows.walk_forward_rate(df, value="x", chunk_seconds=86_400 * 3), "avail_underprod_rate_mh", "avail_underprod_count_mh")
    for site, part in by_site(rows).items():
        seen = {}
        for r in part:
            past = seen.setdefault((r["ts"].month, r["ts"].hour), [])
            rate, count = got[(site, r["ts"])]
            assert count == len(past) and near(rate, sum(past) / len(past) if past else 0.0)
            if r["x"] is not None:
                past.append(r["x"])


def test_trailing_days_is_closed_left(spark):
    rows = hours(200, seed=4)
    got = collected(windows.trailing_days_mean(frame(spark, 200, seed=4), value="x", out="m", days=5), "m")
    for site, part in by_site(rows).items():
        for r in part:
            past = [q["x"] for q in part if q["x"] is not None and r["ts"] - dt.timedelta(days=5) <= q["ts"] < r["ts"]]
            assert near(got[(site, r["ts"])][0], sum(past) / len(past) if past else 0.0)


def test_time_windows_cross_buckets(spark):
    df = frame(spark, 150, seed=6)
    a = collected(windows.rolling_columns_by_time(df, "x", prefix="v", hours=(6,), bucket_hours=10), "v_roll_mean_6h")
    b = collected(windows.rolling_columns_by_time(df, "x", prefix="v", hours=(6,), bucket_hours=100_000), "v_roll_mean_6h")
    assert all(near(a[k][0], b[k][0]) for k in b)


def test_sequences_are_whole_and_ordered(spark):
    rows = hours(60, seed=7, sites={0: 60}, gap=0.0)
    df = frame(spark, 60, seed=7, sites={0: 60}, gap=0.0)
    seq = {r["ts"]: [s["y"] for s in r["sequence"]] for r in windows.lookback_sequences(df, features=["y"], target="y", rows=12).collect()}
    part = by_site(rows)[0]
    assert len(seq) == len(part) - 12
    for i in range(12, len(part)):
        assert seq[part[i]["ts"]] == [p["y"] for p in part[i - 12:i]]
    days = windows.day_sequences(df, features=["y"], target="y").collect()
    assert days and all(len(d["sequence"]) == 24 and [s["ts"] for s in d["sequence"]] == sorted(s["ts"] for s in d["sequence"]) for d in days)


def test_ramp_thresholds_and_no_look_ahead(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(0, base + dt.timedelta(hours=i), v) for i, v in enumerate((0.5, 1.5, 2.0, 2.5, 4.0))]
    df = spark.createDataFrame(data, "site_id long, ts timestamp_ntz, wind_speed_120m double")
    rows = windows.ramp_columns(df).orderBy("ts").collect()
    assert [r["is_sub_cutin"] for r in rows] == [1, 1, 0, 0, 0]
    assert [r["is_sub_cutin_soft"] for r in rows] == [1.0, 1.0, 1.0, 0.5, 0.0]
    assert all(r["dv_6h"] == 0.0 for r in rows)
    changed = spark.createDataFrame(data[:-1] + [(0, data[-1][1], 25.0)], df.schema)
    again = windows.ramp_columns(changed).orderBy("ts").collect()
    assert [tuple(r) for r in again[:-1]] == [tuple(r) for r in rows[:-1]]
