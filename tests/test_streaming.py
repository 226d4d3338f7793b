import datetime as dt
import random

from pyspark.sql import functions as F

from galeframe.operators import cleaning, kalman
from galeframe.streaming import feeds
from tests.helpers import by_site, hours, near, table

SCHEMA = "site_id long, ts timestamp, power_mw double, n_repair int, wind_speed_10m double, wind_speed_80m double, wind_speed_120m double, wind_gusts_10m double"


def readings(rows):
    return [{"site_id": r["site_id"], "ts": r["ts"], "power_mw": r["y"], "n_repair": 0, "wind_speed_10m": r["x"], "wind_speed_80m": r["x"],
             "wind_speed_120m": r["x"], "wind_gusts_10m": r["x"]} for r in rows]


def stream_of(spark, path, parts, schema):
    """One folder, one file per part, read one file per batch in the order written."""
    import time
    frames = [table(spark, p, schema) for p in parts]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return feeds.read_feed(spark, path, frames[0].schema, files_per_batch=1)


def test_clean_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    rows = sorted(readings(hours(120, seed=30, null=0.0, sites={0: 120})), key=lambda r: r["ts"])
    early, late = rows[:60], rows[60:]
    stale = {**early[0], "power_mw": 50.0, "ts": early[0]["ts"] - dt.timedelta(days=30)}
    out = feeds.run_available(feeds.clean_readings(stream_of(spark, str(tmp_path / "f"), [early + early[:10], late, [stale]], SCHEMA), delay="3 hours"))
    got = sorted((r["ts"], r["impossible_reason"]) for r in out.collect())
    want = sorted((r["ts"], r["impossible_reason"]) for r in cleaning.impossible_reasons(table(spark, rows, SCHEMA)).withColumn("ts", F.col("ts").cast("timestamp")).collect())
    assert got == want


def test_window_stream_equals_batch(spark, tmp_path):
    rows = sorted(readings(hours(80, seed=31, null=0.1)), key=lambda r: r["ts"])
    out = feeds.run_available(feeds.window_statistics(stream_of(spark, str(tmp_path / "f"), [rows[:30], rows[30:]], SCHEMA), "wind_speed_120m", delay="60 days"),
                              keys=["site_id", "window_start", "window_end"])
    got = {(r["site_id"], r["window_start"]): (r["n"], r["mean"]) for r in out.collect()}
    want = {}
    for r in rows:
        for k in range(6):
            want.setdefault((r["site_id"], r["ts"] - dt.timedelta(hours=k)), []).append(r["wind_speed_120m"])
    assert got.keys() == want.keys()
    for k, vs in want.items():
        v = [x for x in vs if x is not None]
        assert got[k][0] == len(v) and near(got[k][1], sum(v) / len(v) if v else None)


def test_level_state_carries_over_batches(spark, tmp_path):
    schema = "site_id long, ts timestamp, bias double"
    rows = sorted(({"site_id": r["site_id"], "ts": r["ts"], "bias": r["x"]} for r in hours(60, seed=32, null=0.2)), key=lambda r: r["ts"])
    with feeds.ordered_state(spark):
        out = feeds.run_available(feeds.filter_levels(stream_of(spark, str(tmp_path / "f"), [rows[:25], rows[25:45], rows[45:]], schema)))
    got = {(r["site_id"], r["ts"]): r["level"] for r in out.collect()}
    assert len(got) == len(rows)
    for site, part in by_site(rows).items():
        x, p = 0.0, kalman.FALLBACK_P0
        for r in part:
            p += kalman.FALLBACK_Q
            if r["bias"] is not None:
                k = p / (p + kalman.FALLBACK_R)
                x, p = x + k * (r["bias"] - x), (1 - k) * p
            assert near(got[(site, r["ts"])], x, 1e-9)


def test_level_stream_orders_rows_and_tells_late_ones(spark):
    rnd = random.Random(9)
    start, wait = dt.datetime(2024, 1, 1), dt.timedelta(hours=12)
    rows = [(site, start + dt.timedelta(hours=h), None if h % 13 == 4 else rnd.uniform(-3, 3), min(4, h // 24 + (2 if h % 17 == 3 else 1 if h % 5 == 2 else 0)))
            for site, n in ((0, 110), (1, 40), (2, 1)) for h in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, bias double, batch int").repartition(3)
    with feeds.ordered_state(spark):
        out = feeds.run_available(feeds.filter_levels(feeds.replayed(df, "batch", range(5)), delay=wait)).collect()
    assert spark.conf.get(feeds.ordered_state.NAME, "") != feeds.ordered_state.STORE
    got = {(r["site_id"], r["ts"]): (r["level"], r["late"]) for r in out}
    want = {}
    for site in (0, 1, 2):
        mine = [r for r in rows if r[0] == site]
        before = {b: max((t for _, t, _, n in mine if n < b), default=None) for b in range(5)}
        late = {t for _, t, _, n in mine if before[n] is not None and t <= before[n] - wait}
        x, p, end = 0.0, kalman.FALLBACK_P0, max(t for _, t, _, _ in mine) - wait
        for _, t, v, _ in sorted((r for r in mine), key=lambda r: r[1]):
            if t in late:
                want[site, t] = (None, True)
            elif t <= end:
                p += kalman.FALLBACK_Q
                if v is not None:
                    k = p / (p + kalman.FALLBACK_R)
                    x, p = x + k * (v - x), (1 - k) * p
                want[site, t] = (x, False)
    assert any(late for _, late in want.values()) and got.keys() == want.keys() and len(out) == len(got)
    assert all(got[k][1] == want[k][1] and near(got[k][0], want[k][0]) for k in want)


def test_late_rows_are_counted_and_old_state_goes(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(0, start + dt.timedelta(hours=h), 1.0, 0, 5.0, 5.0, 5.0, 6.0, 2 + h // 24 if h % 8 == 1 else h // 24) for h in range(24 * 6)]
    rows += [r[:-1] + (r[-1] + 1,) for r in rows[::3]]  # again, one trigger later
    df = spark.createDataFrame(rows, SCHEMA + ", batch int")
    told = []
    out = feeds.run_available(feeds.clean_readings(feeds.replayed(df, "batch", range(9)), delay="12 hours"), told=told)
    tops = {b: max((r[1] for r in rows if r[-1] < b - 1), default=None) for b in range(9)}
    late = [r for r in rows if tops[r[-1]] is not None and r[1] <= tops[r[-1]] - dt.timedelta(hours=12)]
    assert late and {r["ts"] for r in out.collect()} == {r[1] for r in rows if r not in late} and out.count() == len({r[1] for r in rows if r not in late})
    assert sum(t["late"] for t in told) == len(late)
    assert max(t["in_state"] for t in told) < 24 * 4  # the state of a day goes once it has been passed
