"""Fitted models: trees against plain versions, leaks, side-by-side growth, exact AUC."""

import datetime as dt
import itertools
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeframe import session
from galeframe.models import boosting, regimes
from galeframe.models.histogram import (BINS, Fit, Settings, Trees, block_of, blocks_of, few_at_once, fit_models, gradient, gradient_sums, histogram, histogram_by_sign,
                                        middle, split, walk)

START = dt.datetime(2024, 1, 1)
SCHEMA = "site_id long, ts timestamp_ntz, a double, b double, wind_speed_120m double, y double, fold int"
FEW = Settings(rounds=4, depth=3, rate=0.5, features=1.0)


def rows(n, seed=1):
    """y steps at a = 3, is high where b is missing, and depends on nothing else."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rnd.choice([None, rnd.uniform(0, 10)]), rnd.choice([None, rnd.uniform(0, 1), rnd.uniform(0, 1)])
        y = (20.0 if a is not None and a > 3 else 5.0) + (40.0 if b is None else 0.0) + rnd.uniform(-1, 1)
        out.append((i % 3, START + dt.timedelta(hours=i // 3), a, b, rnd.uniform(0, 25), None if i % 97 == 5 else y, 2 + i * 4 // n))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(1500), SCHEMA).repartition(5)


def told(df, models, *keep):
    return {(r["site_id"], r["ts"]): list(r["p"]) for r in df.select("site_id", "ts", models.predictions().alias("p")).collect()}


def test_split_against_trying_all():
    rng = np.random.default_rng(0)
    s = Settings(least=2.0)
    for _ in range(40):
        bins, grad, node = rng.integers(0, 6, (80, 2)), rng.normal(size=80), rng.integers(0, 3, 80)
        sums = np.zeros((3, 2, 6, 2))
        for f in range(2):
            np.add.at(sums, (node, f, bins[:, f]), np.stack([grad, np.ones(80)], 1))
        feature, cut, missing, gain = split(sums, np.array([True, True]), s)
        for node in range(3):
            best = 0.0
            for f, c, side in itertools.product(range(2), range(1, 6), (0, 1)):
                left = sums[node, f, 1:c + 1].sum(0) + side * sums[node, f, 0]
                right = sums[node, f].sum(0) - left
                if left[1] >= 2 and right[1] >= 2:
                    whole = left + right
                    best = max(best, left[0]**2 / (left[1] + 1) + right[0]**2 / (right[1] + 1) - whole[0]**2 / (whole[1] + 1))
            assert gain[node] == pytest.approx(best, abs=1e-9) and (best > 1e-9 or cut[node] == 255)


def test_middle_is_the_weighted_median():
    weight = np.zeros(1000)
    for value, w in ((1.0, 2.0), (5.0, 1.0), (7.0, 5.0)):
        weight[int(value * 100)] += w
    assert 7.0 <= middle(weight, 0.0, 10.0) <= 7.01
    assert middle(np.zeros(5), 0.0, 1.0) == 0.0


def test_trees_find_steps_and_the_missing_branch(frame):
    models = fit_models(frame, features=["a", "b"], target=F.col("y"), weights=[F.lit(1.0)], settings=Settings(rounds=12, depth=3, rate=0.5, features=1.0))
    errors = frame.select(F.abs(F.col("y") - F.get(models.predictions(), 0)).alias("e")).agg(F.avg("e")).first()[0]
    assert errors < 1.0
    assert models.importance(0).sum() == pytest.approx(1.0) and (models.importance(0) > 0.05).all()


def test_models_grown_together_equal_models_grown_alone(frame):
    weights = [F.when(F.col("fold") < 4, F.lit(1.0)), F.when(F.col("a") > 5, F.lit(2.0)).otherwise(0.3), F.lit(0.0)]
    judged = [F.when(F.col("fold") == 4, F.lit(1.0)), F.lit(0.0), F.lit(1.0)]
    both = fit_models(frame, features=["a", "b"], target=F.col("y"), weights=weights, judged=judged, seeds=[1, 2, 3], settings=FEW)
    assert both.fitted == [True, True, False] and len(both.trees[1].leaf) == 4 and both.trees[2].leaf == []
    for m in range(2):
        alone = fit_models(frame, features=["a", "b"], target=F.col("y"), weights=weights[m:m + 1], judged=judged[m:m + 1], seeds=[m + 1], settings=FEW)
        assert alone.trees[0].feature == both.trees[m].feature and np.allclose(alone.trees[0].leaf, both.trees[m].leaf, atol=1e-9)


def test_walk_against_one_row_at_a_time():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 65, (500, 3)).astype(np.uint8)
    f, c, m = rng.integers(0, 3, 7), rng.choice([1, 20, 64, 255], 7), rng.random(7) < 0.5
    want = []
    for row in bins:
        node = 0
        for _ in range(3):
            b = row[f[node]]
            node = 2 * node + 1 + int(not m[node] if b == 0 else b > c[node])
        want.append(node - 7)
    assert walk(bins, f.tolist(), c.tolist(), m.tolist(), 3).tolist() == want


def test_margins_of_a_block_are_those_of_its_trees():
    """Models are told apart, rows that a model neither learns from nor is judged by have no margin, and trees after the written ones are added."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (40, 2)).astype(np.uint8), rng.normal(size=40)
    w, v = (rng.random((2, 40)) < 0.4).astype(np.float32), (rng.random((2, 40)) < 0.2).astype(np.float32)
    trees = [Trees(b, feature=[[0], [1]], cut=[[2], [1]], missing=[[True], [False]], leaf=[[b, 2.0], [3.0, -b]]) for b in (1.0, 5.0)]
    (plain,) = blocks_of(iter([block_of(40, x, y, w, v, b"")]), 2, 2, [], 0)
    whole = [plain.part(m, trees[m]) for m in range(2)]
    for m, (own, bins, margin) in enumerate(whole):
        assert own.tolist() == [i for i in range(40) if w[m, i] or v[m, i]] and (bins == x[own]).all()
        assert margin.tolist() == pytest.approx([trees[m].base + sum(leaf[int(x[i, f] > c if x[i, f] else not g)] for (f,), (c,), (g,), leaf in zip(trees[m].feature, trees[m].cut, trees[m].missing, trees[m].leaf)) for i in own])
    first = [Trees(t.base, *(p[:1] for p in (t.feature, t.cut, t.missing, t.leaf))) for t in trees]
    written = np.concatenate([plain.part(m, first[m])[2] for m in (1, 0)])
    (block,) = blocks_of(iter([block_of(40, x, y, w, v, written)]), 2, 2, [1, 0], 1)
    assert all(np.allclose(block.part(m, trees[m])[2], whole[m][2]) for m in range(2))


def test_blocks_hold_weights_by_the_kinds_of_rows():
    """25 models of 24 hours and all took 200 bytes a row of weights; a row's kind takes one, and a weight of its own for every row still fits."""
    rng = np.random.default_rng(5)
    x, y, hour = rng.integers(0, 65, (3000, 9)).astype(np.uint8), rng.normal(size=3000), rng.integers(0, 24, 3000)
    w = np.concatenate([hour == np.arange(24)[:, None], np.ones((1, 3000))]).astype(np.float32)
    assert block_of(3000, x, y, w, np.zeros_like(w)).nbytes < 25 * 3000
    w[24] = rng.random(3000)
    (block,) = blocks_of(iter([block_of(3000, x, y, w, w[::-1])]), 9, 25, [], 0)
    every = np.arange(3000)
    assert all((block.weight(m, every) == w[m]).all() and (block.weight(m, every, 1) == w[24 - m]).all() for m in range(25))
    assert block.learnt(3).tolist() == np.flatnonzero(hour == 3).tolist() and (block.x == x).all()


@pytest.mark.parametrize("rows", [300, 5000])
def test_histograms_against_plain_sums(rows):
    rng = np.random.default_rng(6)
    x, place, w = rng.integers(0, BINS + 1, (rows, 3)).astype(np.uint8), rng.integers(0, 4, rows), rng.choice(np.float32([0.3, 2.0]), rows).astype(float)
    y, margin = rng.integers(0, 4, (2, rows)).astype(float)
    for loss in ("absolute", "logistic"):
        g, h = gradient(loss, y, margin)
        want = np.zeros((4, 3, BINS + 1, 2))
        for f in range(3):
            np.add.at(want, (place, f, x[:, f]), np.stack([g * w, h * w], 1))
        told = histogram_by_sign(x, place, 4, np.sign(y - margin), w) if loss == "absolute" else np.stack([histogram(x, place, 4, a * w) for a in (g, h)])
        assert gradient_sums(told, loss) == pytest.approx(want, abs=1e-9)


def test_blocks_reach_workers_a_few_at_once_and_splits_read_no_margins(spark, frame):
    """A task's blocks came in one batch, so a worker's memory grew with the rows of its task."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(100, numPartitions=1)
    with few_at_once(spark):
        assert many.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 8
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual
    fit = Fit(frame, features=["a", "b"], target=F.col("y"), weights=[F.lit(1.0), F.when(F.col("fold") < 4, 2.0)], judged=[F.lit(0.0)] * 2, settings=FEW, seeds=[1, 2])
    for t in fit.trees:
        t.base = 20.0
    before = fit._pass([0, 1], {}, "split")
    fit.trees = [Trees(20.0, [[0]], [[30]], [[True]], [[0.0, 0.0]], [[1.0]]) for _ in fit.trees]
    fit._write_margins([0, 1])
    fit.seeds = [1, 2]
    fit.rows = fit.rows.drop("y", "margin").withColumns({n: F.lit(b"") for n in ("y", "margin")})  # a reader of them would fail
    after = fit._pass([0, 1], {}, "split")
    assert all((before[m][k] == after[m][k]).all() for m in (0, 1) for k in ("feature", "cut", "missing", "gain"))


def test_a_fit_leaves_nothing_in_workers_and_no_blocks(spark, frame):
    """Workers live on through later stages, so what they keep of a fit would grow with its rows."""
    def kept(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": [sum(name.startswith("_galeframe_margins") for name in sys.modules)] * b.num_rows})

    before = list(session._FOLDERS)
    fit_models(frame, features=["a", "b"], target=F.col("y"), weights=[F.lit(1.0)], settings=FEW)
    assert session._FOLDERS == before
    assert spark.range(64, numPartitions=16).mapInArrow(kept, "id long").agg(F.sum("id")).first()[0] == 0


def test_rows_without_weight_do_not_matter(spark, frame):
    """The predictions of a fold stay the same when its own and later targets change: they only end the growth."""
    changed = frame.withColumn("y", F.when(F.col("fold") >= 4, F.col("y") * 3.0 - 50.0).otherwise(F.col("y")))
    kept = [fit_models(d, features=["a", "b"], target=F.col("y"), weights=[F.when(F.col("fold") < 4, F.lit(1.0))], bounds=(-60.0, 150.0), settings=FEW) for d in (frame, changed)]
    assert told(frame, kept[0]) == told(frame, kept[1])


def test_early_stop_keeps_the_best_round(frame):
    noise = frame.withColumn("y", F.when(F.col("fold") < 5, F.col("y")).otherwise(F.lit(20.0)))
    models = fit_models(noise, features=["a", "b"], target=F.col("y"), weights=[F.when(F.col("fold") < 5, F.lit(1.0))], judged=[F.when(F.col("fold") == 5, F.lit(1.0))],
                        settings=Settings(rounds=30, depth=3, rate=0.5, patience=2, features=1.0))
    assert len(models.trees[0].leaf) < 5


def test_bag_walks_forward(frame):
    held, scored = boosting.cross_validated_bag(frame, frame.filter("fold = 5"), folds=(3, 4, 5), features=["a", "b"], target="y", seeds=(1,), settings=FEW)
    out = held.collect()
    assert {r["fold"] for r in out} == {3, 4, 5} and all(r["raw_pred"] is not None for r in out)
    error = np.mean([abs(r["raw_pred"] - r["y"]) for r in out if r["y"] is not None])
    assert error < 12.0
    row = scored.filter("test_mean IS NOT NULL").first()
    assert row["test_mean"] == pytest.approx(np.mean([row[f"test_fold{f}"] for f in (3, 4, 5)]))


def test_hours_with_few_rows_use_the_model_of_all(frame):
    val = frame.filter("fold = 5")
    out = boosting.hourly_models(frame.filter("fold < 5 AND (hour(ts) <> 7)"), val, features=["a", "b"], target="y", min_rows=20, settings=FEW).collect()
    assert {r["hour_model"] for r in out if r["ts"].hour == 7} == {None} and {r["hour_model"] for r in out if r["ts"].hour == 8} == {8}
    assert all(r["hourly_pred"] is not None for r in out) and len(out) == val.count()


def test_noisy_median(frame):
    val = frame.filter("fold = 5")
    models = boosting.fit_band_ensemble(frame.filter("fold < 5"), val, features=["a", "b"], target="y", seeds=(1, 2), settings=FEW)
    plain = {(r["site_id"], r["ts"]): r["p"] for r in boosting.predict_ensemble(models, val, out="p").collect()}
    still = {(r["site_id"], r["ts"]): r["median_pred"] for r in boosting.noisy_median(models, val, scale=0.0).collect()}
    assert still.keys() == plain.keys() and all(still[k] == pytest.approx(plain[k]) for k in plain)
    one, two = (sorted((r["site_id"], r["ts"], r["median_pred"]) for r in boosting.noisy_median(models, d, copies=6).collect()) for d in (val, val.repartition(3)))
    assert one == two and any(p != plain[s, t] for s, t, p in one)
    keys = np.arange(4000, dtype=np.int64)
    drawn = boosting.normal(keys, 3, 2)
    assert abs(drawn.mean()) < 0.02 and abs(drawn.std() - 1.0) < 0.02
    assert abs(np.corrcoef(drawn.reshape(len(keys), -1).T) - np.eye(6)).max() < 0.06


def test_area_under_curve(spark):
    rnd = random.Random(4)
    data = [(g, rnd.choice([None, float("nan"), 0.5, rnd.random(), round(rnd.random(), 1)]), rnd.choice([0, 0, 1, None])) for g in (None, 1, 2) for _ in range(200)]
    data += [(3, 0.5, 1)] * 3 + [(4, 0.1, 0), (4, 0.1, 1)]
    df = spark.createDataFrame(data, "g int, s double, y int")
    want = {}
    for g in {d[0] for d in data}:
        ones, zeros = ([s for h, s, y in data if h == g and y == label and s is not None and s == s] for label in (1, 0))
        pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in ones for b in zeros]
        want[g] = sum(pairs) / len(pairs) if pairs else None
    for cells in (1, 3, 4096):
        got = {r["g"]: r["auc"] for r in boosting.area_under_curve(df, score="s", label="y", by="g", cells=cells).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) if want[g] is not None else got[g] is None for g in want)


def test_train_or_score_takes_out_what_gives_away(frame):
    train, score = frame.filter("fold < 4").withColumn("give", F.lit(1.0)), frame.filter("fold >= 4").withColumn("give", F.lit(2.0))
    aucs, probs, log = boosting.train_or_score(train, score, features=["a", "give", "b"], settings=FEW)
    assert log[0][1] == pytest.approx(1.0) and log[0][2] == "give" and log[1][1] < 0.7 and log[1][2] is None
    assert {r["fold"] for r in aucs.collect()} == set(range(5)) and probs.count() == frame.count()
    assert all(0.0 <= r["av_prob"] <= 1.0 for r in probs.collect())


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    models = fit_models(df, features=["a", "b"], target=F.col("y"), weights=[F.lit(1.0)], settings=FEW)
    assert models.fitted == [False]
    one = spark.createDataFrame(rows(1), SCHEMA)
    models = fit_models(one, features=["a", "b"], target=F.col("y"), weights=[F.lit(1.0)], settings=FEW)
    assert one.select(F.get(models.predictions(), 0).alias("p")).first()["p"] == pytest.approx(one.first()["y"], abs=1e-6)


def test_clusters_are_at_rest_and_repeat(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 2)) * 20.0
    data = [(i % 3, START + dt.timedelta(hours=i // 3), *map(float, centre[i % 4] + rng.normal(size=2))) for i in range(800)] + [(9, START, None, 1.0), (9, START + dt.timedelta(hours=1), 1.0, None)]
    df = spark.createDataFrame(data, "site_id long, ts timestamp_ntz, a double, b double")
    told, centres = regimes.cluster(df, columns=["a", "b"], k=4, tolerance=1e-9)
    again, same = regimes.cluster(df.repartition(7), columns=["a", "b"], k=4, tolerance=1e-9)
    key = lambda r: (r["site_id"], r["ts"])
    got = {key(r): r["regime_cluster"] for r in told.collect()}
    assert got == {key(r): r["regime_cluster"] for r in again.collect()} and np.allclose(centres, same)
    points = {key(r): np.array(r[regimes.POINT]) for r in regimes.standardised(df, ["a", "b"]).collect()}
    for k, p in points.items():
        assert np.square(centres - p).sum(1).argmin() == got[k]
    for j in range(4):
        assert np.allclose(np.mean([points[k] for k in points if got[k] == j], axis=0), centres[j])
    assert len({(i % 4, got[data[i][0], data[i][1]]) for i in range(800)}) == 4  # the groups drawn are the clusters
    few, some = regimes.cluster(df.limit(2), columns=["a", "b"], k=5)
    assert len(some) == 2 and few.count() == 2
    none, empty = regimes.cluster(df.limit(0), columns=["a", "b"])
    assert none.count() == 0 and len(empty) == 0
