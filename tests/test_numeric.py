import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.functions.curve import POWER_KW, turbine_power_kw
from galeframe.functions.nullsafe import bin_left_closed, bin_right_closed, clip, sector_clamped, sector_wrapped
from galeframe.operators import analogs, cleaning, kalman, smoothing
from galeframe.operators.isotonic import FAN, apply_isotonic, fit_isotonic, segments
from galeframe.operators.ranks import percentiles, table_medians
from tests.helpers import by_site, collected, frame, hours, near


def values(spark, n, seed, ties):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else "cold", round(rnd.gauss(0, 5), 1) if ties else rnd.gauss(0, 5)) for _ in range(n)]
    rows += [("one", 3.25), ("hot", None)]
    return rows, spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_percentiles_are_exact(spark, ties, width):
    rows, df = values(spark, 500, 11, ties)
    qs = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}
    got = {r["k"]: r for r in percentiles(df, ["k"], "v", qs, width=width, count="n").collect()}
    for k in ("hot", "cold", "one"):
        v = np.array([x for g, x in rows if g == k and x is not None])
        assert got[k]["n"] == len(v)
        for name, q in qs.items():
            assert near(got[k][name], float(np.percentile(v, q * 100)))
    whole = percentiles(df, [], "v", {"m": 0.5}, width=width).first()["m"]
    assert near(whole, float(np.median([x for _, x in rows if x is not None])))


@pytest.mark.parametrize("ties", [True, False])
def test_trimmed_spread(spark, ties):
    rows, df = values(spark, 400, 12, ties)
    got = {r["k"]: r["sigma"] for r in cleaning.trimmed_spread(df, ["k"], "v").collect()}
    for k in ("hot", "cold"):
        v = np.sort([x for g, x in rows if g == k and x is not None])
        cut = int(np.floor(0.05 * len(v)))
        assert near(got[k], float(np.std(v[cut:len(v) - cut])), 1e-8)
    assert got["one"] is None


def test_medians_of_several_columns_in_one_pass(spark):
    import statistics
    rnd = random.Random(8)
    rows = [(rnd.gauss(1000, 9), rnd.choice([1.5, 2.5, None]), 7, None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c long, d double, _name long")
    medians = table_medians(df, {"a": 1.0, "b": 1e-3, "c": 50.0, "d": 1.0})
    got = spark.range(1).select(*[e.alias(n) for n, e in medians.items()]).first()
    assert got["d"] is None and got["c"] == 7.0
    assert got["a"] == statistics.median(r[0] for r in rows) and got["b"] == statistics.median(r[1] for r in rows if r[1])
    empty = table_medians(df.filter("false"), {"a": 1.0})
    assert spark.range(1).select(empty["a"].alias("m")).first()["m"] is None


def pava(x, y, least=0.0, most=90.09):
    blocks = []
    for xi in sorted(set(x)):
        ys = [b for a, b in zip(x, y) if a == xi]
        blocks.append([[xi], sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return [(xi, min(most, max(least, s / n))) for xs, s, n in blocks for xi in xs]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_isotonic_curve_pools_in_any_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rnd = random.Random(3)
        rows = [(s, round(rnd.uniform(0, 25), 1), 0.0) for s in (0, 1) for _ in range(300)]
        rows = [(s, x, max(0.0, 4 * x + rnd.gauss(0, 15))) for s, x, _ in rows]
        df = spark.createDataFrame(rows, "site_id long, x double, y double")
        table = segments(fit_isotonic(df, ["site_id"], "x", "y"), ["site_id"])
        probe = [(s, q) for s in (0, 1) for q in (-1.0, 0.05, 3.33, 12.0, 12.05, 24.99, 30.0)]
        got = apply_isotonic(spark.createDataFrame(probe, "site_id long, x double"), table, ["site_id"], {"p": "x"}).collect()
        for s in (0, 1):
            knots = pava([x for k, x, _ in rows if k == s], [y for k, _, y in rows if k == s])
            for r in got:
                if r["site_id"] == s:
                    assert near(r["p"], float(np.interp(r["x"], *zip(*knots))), 1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def rts(y, q, r, p0):
    x, p, xs, ps = 0.0, p0, [], []
    for v in y:
        p += q
        if v is not None:
            k = p / (p + r)
            x, p = x + k * (v - x), (1 - k) * p
        xs.append(x)
        ps.append(p)
    s = list(xs)
    for t in range(len(y) - 2, -1, -1):
        s[t] = xs[t] + ps[t] / (ps[t] + q) * (s[t + 1] - xs[t])
    return xs, s


@pytest.mark.parametrize("block_rows", [1, 7, 10_000])
def test_level_smoother_equals_the_row_by_row_recursion(spark, block_rows):
    rows = hours(90, seed=9, null=0.3)
    df = kalman.smooth_level(frame(spark, 90, seed=9, null=0.3), F.col("x"), out="s", filtered="f", block_rows=block_rows)
    got = collected(df, "f", "s")
    for site, part in by_site(rows).items():
        xs, sm = rts([r["x"] for r in part], kalman.FALLBACK_Q, kalman.FALLBACK_R, kalman.FALLBACK_P0)
        for r, a, b in zip(part, xs, sm):
            f, s = got[(site, r["ts"])]
            assert near(f, a, 1e-9) and near(s, b, 1e-9)


def test_constant_bias_is_found(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0, start + dt.timedelta(hours=i), 2.5) for i in range(120)], "site_id long, ts timestamp_ntz, b double")
    rows = kalman.smooth_level(df, F.col("b"), out="s").orderBy("ts").collect()
    assert all(abs(r["s"] - 2.5) < 0.5 for r in rows[50:])


def test_likelihood_is_the_same_in_blocks(spark):
    df = frame(spark, 80, seed=10)
    a = {(r["site_id"], r["q"], r["r"]): r["log_likelihood"] for r in kalman.likelihood_table(df, F.col("x"), q_grid=(1e-2, 1.0), r_grid=(0.5, 8.0), block_rows=9).collect()}
    b = {(r["site_id"], r["q"], r["r"]): r["log_likelihood"] for r in kalman.likelihood_table(df, F.col("x"), q_grid=(1e-2, 1.0), r_grid=(0.5, 8.0)).collect()}
    assert len(a) == 8 and all(near(a[k], b[k]) for k in b)
    for site, part in by_site(hours(80, seed=10)).items():
        y = np.array([np.nan if r["x"] is None else r["x"] for r in part])
        for q, r in ((1e-2, 0.5), (1.0, 8.0)):
            assert near(a[(site, q, r)], kalman._filter(y, q, r, 0.0, kalman.FITTED_P0)[3])
    chosen = kalman.choose_parameters(kalman.likelihood_table(df, F.col("x")), min_rows=50).collect()
    assert {r["site_id"]: r["p0"] for r in chosen} == {0: kalman.FITTED_P0, 1: kalman.FALLBACK_P0}


def test_quadratic_smoothing_matches_polynomial_fits(spark):
    rows = hours(40, seed=13, sites={0: 40, 1: 4})
    got = collected(smoothing.quadratic_smooth(frame(spark, seed=13, sites={0: 40, 1: 4}), pred="y"), "smooth_mw")
    for site, part in by_site(rows).items():
        y = np.array([r["y"] for r in part])
        want = y.copy()
        if len(y) >= 5:
            for i in range(len(y)):
                a = min(max(i - 2, 0), len(y) - 5)
                want[i] = np.polyval(np.polyfit(np.arange(5), y[a:a + 5], 2), i - a)
        for r, v in zip(part, np.clip(want, 0, 90.09)):
            assert near(got[(site, r["ts"])][0], float(v), 1e-8)


@pytest.mark.parametrize("span", [3, 12])
def test_exponential_mean_in_blocks(spark, span):
    rows = hours(700, seed=14, sites={0: 700})
    df = smoothing.exponential_smooth(frame(spark, seed=14, sites={0: 700}), pred="y", span=span, both="b", block_rows=50)
    got = collected(df, "ema_mw", "b")
    part, alpha = by_site(rows)[0], 2 / (span + 1)

    def ema(v):
        out = [v[0]]
        for x in v[1:]:
            out.append(alpha * x + (1 - alpha) * out[-1])
        return out
    y = [r["y"] for r in part]
    fwd, bwd = ema(y), ema(y[::-1])[::-1]
    for r, a, b in zip(part, fwd, bwd):
        e, both = got[(0, r["ts"])]
        assert near(e, a, 1e-12) and near(both, (a + b) / 2, 1e-12)


def test_rolling_median_reflects_edges(spark):
    rows = hours(30, seed=15, sites={0: 30})
    got = collected(smoothing.rolling_median(frame(spark, seed=15, sites={0: 30}), pred="y", rows=(3, 7)), "median_3_mw", "median_7_mw")
    part = by_site(rows)[0]
    y = np.array([r["y"] for r in part])
    for j, w in enumerate((3, 7)):
        p = w // 2
        padded = np.concatenate([y[p:0:-1], y, y[-2:-p - 2:-1]])
        for i, r in enumerate(part):
            assert near(got[(0, r["ts"])][j], float(np.median(padded[i:i + w])))


def test_nearest_rows_in_cells_equal_brute_force(spark):
    rnd, start = random.Random(5), dt.datetime(2024, 1, 1)
    schema = "site_id long, ts timestamp_ntz, a double, b double"
    def value():
        return rnd.choice([0.5, 0.25, rnd.random(), rnd.random()])  # ties and equal rows
    rows = [(s, start + dt.timedelta(hours=i), value(), value()) for s, n in ((0, 400), (1, 12)) for i in range(n)]
    rows += [(3, start + dt.timedelta(hours=i), 0.5, 0.5) for i in range(300)] + [(4, start, 0.1, 0.9)]  # cannot be split; no history
    asked = {(s, t) for i, (s, t, _, _) in enumerate(rows) if i % 5 == 0 or s == 4}
    df = spark.createDataFrame([(*r, (r[0], r[1]) in asked) for r in rows], schema + ", asked boolean")
    got = {}
    for r in analogs.nearest(df.filter("NOT asked"), df.filter("asked"), ["a", "b"], k=3, block_rows=10).collect():
        got.setdefault((r["site_id"], r["ts"]), []).append((r["rank"], r["analog_ts"]))
    for s, t, a, b in rows:
        if (s, t) in asked:
            pool = sorted(((x - a) ** 2 + (y - b) ** 2, u) for k, u, x, y in rows if k == s and (k, u) not in asked)[:3]
            assert [u for _, u in sorted(got.get((s, t), []))] == [u for _, u in pool]


def test_nearest_visits_few_cells_at_ten_times_the_rows(spark):
    def visited(n: int) -> float:
        base = spark.range(n).selectExpr("0 AS site_id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts", *(f"pmod(xxhash64(id, {j}), 1000003) / 1000003.0e0 AS f{j}" for j in range(3)))
        found = analogs.nearest(base, base.filter("ts < timestamp_ntz'2020-01-03 00:00:00'"), ["f0", "f1", "f2"], k=4, block_rows=64)
        return found.filter("rank = 1").agg(F.avg("cells_visited")).first()[0]
    small, large = visited(2_000), visited(20_000)
    assert large < 1.5 * small + 2 and large < 0.2 * 20_000 / 64


def test_isotonic_zones_and_search_tree_equal_one_task(spark):
    import random
    rnd = random.Random(4)
    rows = [(s, i / 40.0, i / 400.0 + rnd.gauss(0, 3) + (5 if 200 < i < 300 else 0)) for s, n in ((0, 900), (1, 60), (None, 40)) for i in range(n)]
    rows += [(2, i / 2000.0, float(i)) for i in range(6000)]  # nothing pools: every point is a block
    rows += [(3, i / 100.0, float(-i % 90)) for i in range(900)]  # almost everything pools
    rows += [(4, 1.0 + i * 1e-9, float(i % 30)) for i in range(600)]  # crowded x; stretches rise, the curve does not
    rows += [(5, float(i), 7.0) for i in range(200)]  # all means equal
    df = spark.createDataFrame(rows, "site_id long, x double, y double")
    whole = fit_isotonic(df, ["site_id"], "x", "y", y_min=-1e9, y_max=1e9, stretches=1)
    cut = fit_isotonic(df, ["site_id"], "x", "y", y_min=-1e9, y_max=1e9, stretches=60)
    def blocks(curve):
        return sorted(((r["site_id"], r["x_lo"], r["x_hi"], round(r["value"], 9), r["n_rows"]) for r in curve.collect()), key=str)
    assert blocks(cut) == blocks(whole) and cut.select("part").distinct().count() > 1
    assert max(r["count"] for r in cut.groupBy("part").count().collect()) < 0.5 * whole.count()
    a, b = segments(whole, ["site_id"]), segments(cut, ["site_id"])
    assert len(a.levels) == 3 and all(t.selectExpr("max(size(_list)) AS n").first()["n"] <= FAN for t in a.levels)
    probe = spark.createDataFrame([(s, rnd.uniform(-1, 40)) for s in (0, 1, 2, 3) for _ in range(200)] + [(4, 1.0 + i * 3.3e-10) for i in range(1800)], "site_id long, x double")
    def looked_up(curves):
        return sorted((r["site_id"], r["x"], round(r["p"], 9)) for r in apply_isotonic(probe, curves, ["site_id"], {"p": "x", "again": "x"}).collect())
    assert looked_up(a) == looked_up(b)
    for site in (0, 1, 2, 3, 4, 5):  # against pooling in plain Python
        pairs = [(x, y) for k, x, y in rows if k == site]
        knots = pava([x for x, _ in pairs], [y for _, y in pairs], -1e9, 1e9)
        tested = [(x, p) for k, x, p in looked_up(b) if k == site]
        assert all(near(p, float(np.interp(x, *zip(*knots))), 1e-6) for x, p in tested)


def test_power_curve_knots_and_limits(spark):
    points = [(float(w), 1.225, float(v[6])) for w, v in POWER_KW.items()]
    # knots stated a second time, so that a wrong table value cannot pass both sides
    points += [(3.0, 1.06, 29.0), (7.0, 1.15, 1243.0), (10.0, 1.27, 3247.0), (12.0, 1.225, 3452.0), (15.0, 1.1, 3465.0), (20.0, 1.2, 3325.0), (25.0, 1.0, 2418.0)]
    points += [(5.0, 1.225, 434.0), (10.0, 1.225, 3208.0), (8.0, 1.12, 1823.0), (8.0, 1.27, 2067.0), (2.9, 1.2, 0.0), (27.5, 1.2, 0.0), (26.0, 1.2, 2418.0), (8.0, 2.0, 2067.0), (8.5, 1.06, (1724 + 2410) / 2)]
    df = spark.createDataFrame(points, "w double, r double, want double")
    assert all(near(r["kw"], r["want"], 1e-9) for r in df.withColumn("kw", turbine_power_kw("w", "r")).collect())
    nulls = spark.createDataFrame([(None, 1.2), (8.0, None)], "w double, r double").withColumn("kw", turbine_power_kw("w", "r")).collect()
    assert all(r["kw"] is None for r in nulls)


def test_bins_and_sectors(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 2.0, 4.0, 5.0, None, 360.0)], "v double")
    e = (0, 2, 4)
    rows = df.select("v", bin_left_closed("v", e, clamp=True).alias("a"), bin_left_closed("v", e, clamp=False).alias("b"), bin_right_closed("v", e).alias("c"),
                     sector_wrapped("v", 8).alias("w"), sector_clamped("v", 8).alias("k"), clip("v", 0.0, 3.0).alias("q")).collect()
    got = {r["v"]: tuple(r)[1:4] for r in rows}
    assert got[-1.0] == (0, None, None) and got[0.0] == (0, 0, None) and got[2.0] == (1, 1, 0) and got[4.0] == (1, None, 1) and got[None] == (None, None, None)
    last = next(r for r in rows if r["v"] == 360.0)
    assert (last["w"], last["k"]) == (0, 7)
    assert next(r for r in rows if r["v"] is None)["q"] is None


def test_constant_series_have_no_correlation(spark):
    from galeframe.functions.nullsafe import correlation
    from galeframe.operators import ensemble, windows

    df = spark.createDataFrame([(1.0, float(i), None if i % 3 else float(i)) for i in range(30)], "a double, b double, z double")
    row = df.agg(correlation("a", "b").alias("ab"), correlation("b", "z").alias("bz")).first()
    assert row["ab"] is None and abs(row["bz"] - 1.0) < 1e-12
    got = {(r["first"], r["second"]): r["correlation"] for r in ensemble.correlation_table(df, ["a", "b", "z"]).collect()}
    assert got["a", "b"] == 0.0 == got["a", "z"] and 0 < got["b", "z"] < 1
    wide = df.selectExpr("a AS x0", *[f"sin(b * {k}) AS x{k}" for k in range(1, 47)])
    assert ensemble.drop_correlated(wide, [f"x{k}" for k in range(47)]) == [f"x{k}" for k in range(47)]
    assert ensemble.drop_correlated(wide.selectExpr("x0", "x1", "x1 * 2 AS x2"), ["x0", "x1", "x2"]) == ["x0", "x1"]
    flat = spark.createDataFrame([(1, __import__("datetime").datetime(2024, 1, 1, h), 5.0) for h in range(20)], "site_id long, ts timestamp_ntz, power_mw double")
    assert all(r["autocorrelation"] is None for r in windows.lag_autocorrelation(flat).collect())


def test_rows_without_a_time_stay_in_windows(spark):
    from galeframe.operators.blocks import with_row_number

    rows = [(1, None), (1, __import__("datetime").datetime(2024, 1, 1)), (None, __import__("datetime").datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz")
    assert with_row_number(df).count() == 3
