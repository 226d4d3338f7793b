"""Queries over the fitted models and the streaming operators.

What fitted trees predict cannot be told in SQL. The ``_checks`` queries tell what must hold of it for every row instead:
the keys, the bounds of the target, and whether the model beats the best constant of the fold it did not see.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from galeframe.config import SITE, TARGET, TS
from galeframe.models import boosting, regimes
from galeframe.operators import lookups, weather
from galeframe.operators.settle import settle
from galeframe.plans.frames import base, with_feed
from galeframe.plans.oracle.base import BASE, HOURLY, OOF, cols, feed_cte, with_
from galeframe.plans.quality import _ODD, odd
from galeframe.plans.registry import query
from galeframe.sources.derived import hourly, oof
from galeframe.streaming import feeds

INPUTS = ("wind_speed_10m", "wind_speed_80m", "wind_speed_120m", "wind_gusts_10m", "temperature_80m", "pressure_msl", "air_density", "v_eff", "active_turbines")


def frame(spark, sf, first=3, days=10):
    b = base(spark, sf)
    return b.withColumns({"fold": F.least(F.lit(5), first + F.floor((F.dayofmonth(TS) - 1) / days)).cast("int")})


def _halves(spark, sf):
    f = frame(spark, sf)
    return f.filter("fold < 5"), f.filter("fold = 5")


def _checked(df, pred, cfg_max=90.09):
    """Keys and target, whether the prediction lies in the target's range, and whether the fold's predictions beat its best constant."""
    middle = df.agg(F.percentile(TARGET, F.lit(0.5))).first()[0]
    errors = df.agg(F.avg(F.abs(F.col(TARGET) - F.col(pred))).alias("model"), F.avg(F.abs(F.col(TARGET) - F.lit(middle))).alias("constant")).first()
    better = int(errors["model"] is not None and errors["model"] < errors["constant"])
    return df.select(SITE, TS, TARGET, F.col(pred).between(0.0, cfg_max).cast("int").alias("in_bounds"), F.lit(better).alias("beats_constant"))


def _checks_sql(folds: str) -> str:
    return with_(BASE) + "SELECT " + cols({"power_mw": "power_mw"}, {"in_bounds": "CASE WHEN true THEN 1 ELSE 0 END", "beats_constant": "1"}, keys="site_id, CAST(ts AS VARCHAR) AS ts") + f" FROM base WHERE {folds}"


@query("M01_band_ensemble")
def band_ensemble(spark, sf):
    """Three bands and five seeds, all inputs, stopped early on the last fold."""
    train, val = _halves(spark, sf)
    models = boosting.fit_band_ensemble(train, val, features=INPUTS, target=TARGET)
    return boosting.predict_ensemble(models, val, out="pred_mw").select(SITE, TS, TARGET, "pred_mw")


@query("M01_band_checks", _checks_sql("day(ts) > 20"))
def band_checks(spark, sf):
    return _checked(settle(band_ensemble(spark, sf)), "pred_mw")


@query("M02_cross_validated_bag")
def cross_validated_bag(spark, sf):
    """Three folds, three bands, two seeds: 18 models of all inputs."""
    f = frame(spark, sf, first=2, days=8)
    held, scored = boosting.cross_validated_bag(f, f.filter("fold = 5"), folds=(3, 4, 5), features=INPUTS, target=TARGET)
    test = scored.select(F.lit(0).alias("fold"), SITE, TS, F.lit(None).cast("double").alias(TARGET), F.col("test_mean").alias("raw_pred"))
    return held.unionByName(test)


@query("M02_bag_checks", _checks_sql("day(ts) > 8"))
def bag_checks(spark, sf):
    held = settle(cross_validated_bag(spark, sf).filter("fold > 0"))
    return _checked(held, "raw_pred")


@query("M03_top_features")
def top_features(spark, sf):
    return boosting.top_features(frame(spark, sf, first=2, days=8), features=INPUTS, target=TARGET, k=5, fold_weights={3: 0.2, 4: 0.3, 5: 0.5})


@query("M04_residual_ensemble")
def residual_ensemble(spark, sf):
    """All bands on the residual, three seeds, and the mid-wind specialist beside them."""
    train, val = _halves(spark, sf)
    curve = lookups.fit_site_curve(train)
    train, val = (lookups.apply_site_curve(d, curve, wind="v_eff", out="baseline") for d in (train, val))
    bands = {**boosting.BANDS, "mid": (7.0, 12.0)}
    models = boosting.fit_residual_ensemble(train, val, features=INPUTS, target=TARGET, baseline="baseline", bands=bands, seeds=(42, 7, 123))
    return boosting.predict_residual(models, val, baseline="baseline", out="pred_mw").select(SITE, TS, TARGET, "baseline", "pred_mw")


@query("M04_residual_checks", _checks_sql("day(ts) > 20"))
def residual_checks(spark, sf):
    return _checked(settle(residual_ensemble(spark, sf)), "pred_mw")


@query("M05_area_under_curve", with_(BASE, """v AS (SELECT n_repair AS g, round(wind_speed_120m)+temperature_80m*0 AS s, CASE WHEN day(ts) > 20 THEN 1 ELSE 0 END AS y FROM base),
     e AS (SELECT g, s, sum(y) AS one, sum(1-y) AS zero FROM v WHERE s IS NOT NULL GROUP BY g, s), b AS (SELECT *, sum(zero) OVER (PARTITION BY g ORDER BY s)-zero AS below FROM e)""")
       + "SELECT " + cols({"auc": "sum(one*(below+0.5e0*zero))/(sum(one)*sum(zero))"}, {"n_repair": "g"}, keys="") + " FROM b GROUP BY g HAVING sum(one) > 0 AND sum(zero) > 0")
def auc_of_wind(spark, sf):
    """How well rounded wind tells the last fold's rows from the others, with ties, by repair state."""
    b = base(spark, sf).withColumns({"s": F.round("wind_speed_120m") + F.col("temperature_80m") * 0.0, "y": (F.dayofmonth(TS) > 20).cast("int")})
    return boosting.area_under_curve(b, score="s", label="y", by="n_repair").filter("auc IS NOT NULL")


@query("M05_train_or_score")
def train_or_score(spark, sf):
    """Five folds of all inputs; one round of taking out a column that gives the rows away."""
    train, score = _halves(spark, sf)
    aucs, probs, _ = boosting.train_or_score(train, score, features=INPUTS)
    return boosting.probability_by_period(probs).withColumn("mean_auc", aucs.agg(F.avg("auc")).scalar())


def _det(m: list[list[str]]) -> str:
    if len(m) == 2:
        return f"({m[0][0]}*{m[1][1]}-{m[0][1]}*{m[1][0]})"
    return "(" + "+".join(f"{'-' if k % 2 else ''}{m[0][k]}*{_det([r[:k] + r[k + 1:] for r in m[1:]])}" for k in range(len(m))).replace("+-", "-") + ")"


def _ridge_sql(columns: tuple[str, ...], penalties: str) -> list[str]:
    """CTEs from rows ``d`` (h: what is held out, x columns, target_mw) to weights per h and penalty, by Cramer's rule."""
    k = range(len(columns))
    moments = ", ".join([f"avg({n}) AS m{i}, stddev_samp({n}) AS s{i}, count(*)*covar_pop({n}, target_mw)/stddev_samp({n}) AS y{i}" for i, n in enumerate(columns)]
                        + [f"count(*)*covar_pop({columns[i]}, {columns[j]})/(stddev_samp({columns[i]})*stddev_samp({columns[j]})) AS z{i}{j}" for i in k for j in k])
    matrix = [[f"(z{i}{j}+alpha)" if i == j else f"z{i}{j}" for j in k] for i in k]
    weights = ", ".join(f"{_det([[f'y{i}' if j == w else matrix[i][j] for j in k] for i in k])}/{_det(matrix)} AS w{w}" for w in k)
    return [f"mo AS (SELECT h, avg(target_mw) AS my, {moments} FROM d GROUP BY h)", f"al AS (SELECT unnest([{penalties}]) AS alpha)", f"we AS (SELECT *, {weights} FROM mo, al)"]


def _stacked(columns: tuple[str, ...]) -> str:
    return "least(90.09e0, greatest(0.0e0, my+" + "+".join(f"w{i}*({n}-m{i})/s{i}" for i, n in enumerate(columns)) + "))"


_STACK = ("pred_cf_mw", "pred_mw_mw", "ws_120")


@query("M06_ridge_stack", with_(OOF, "d AS (SELECT f.h, o.* FROM (SELECT DISTINCT fold AS h FROM oof) f JOIN oof o ON o.fold <> f.h)", *_ridge_sql(_STACK, "0.1e0, 1.0e0, 10.0e0, 100.0e0"))
       + "SELECT " + cols({"alpha": "alpha", "nmae_pct": f"avg(abs(target_mw-{_stacked(_STACK)}))/90.09e0*100"}, {"fold": "fold"}, keys="") + " FROM oof JOIN we ON we.h = oof.fold GROUP BY alpha, fold")
def ridge_stack(spark, sf):
    table, _ = boosting.ridge_stack(oof(spark, sf), columns=_STACK, target="target_mw", folds=(3, 4, 5))
    return table


_MODELS = {"pred_cf_mw": "pred_cf_mw", "pred_mw_mw": "pred_mw_mw", "wind_line": "least(90.09e0, 2.0e0*ws_120)"}
_GOOD = ("pred_cf_mw", "pred_mw_mw")


@query("M07_quality_stack", with_(OOF, "d AS (SELECT 0 AS h, * FROM oof)", *_ridge_sql(_GOOD, "1.0e0")) + "SELECT " + cols({"target_mw": "target_mw", "stack_mw": _stacked(_GOOD)}, {"fold": "fold"}) + " FROM oof, we")
def quality_stack(spark, sf):
    """The two models under the threshold are stacked; the line through wind is a third that is not."""
    o = oof(spark, sf).withColumns({n: F.expr(e) for n, e in _MODELS.items()})
    good = boosting.good_models(o, list(_MODELS), target="target_mw", below=10.0)
    model = boosting.fit_ridge(o, columns=good, target="target_mw", alpha=1.0)
    return o.withColumn("stack_mw", model.prediction()).select("fold", SITE, TS, "target_mw", "stack_mw")


@query("M08_regime_clusters")
def regime_clusters(spark, sf):
    b = weather.atmosphere_columns(weather.shear_exponent_column(base(spark, sf)))
    return boosting.regime_clusters(b).select(SITE, TS, "regime_cluster")


REGIME = ("hellmann_alpha", "wind_speed_120m", "air_density", "temp_gradient")


@query("M08_cluster_checks", with_(BASE) + "SELECT " + cols({}, {"with_nearest": "1", "centre_is_mean": "1"}, keys="site_id, CAST(ts AS VARCHAR) AS ts") + " FROM base")
def cluster_checks(spark, sf):
    """For every row: whether no other centre is nearer than its own, and whether that is the mean of its rows."""
    b = regimes.standardised(weather.atmosphere_columns(weather.shear_exponent_column(base(spark, sf))), REGIME)
    told, centres = regimes.cluster(b, columns=REGIME)
    told = settle(told.join(b.select(SITE, TS, regimes.POINT), [SITE, TS]).select(SITE, TS, "regime_cluster", regimes.POINT))
    means = {r["regime_cluster"]: r["m"] for r in told.groupBy("regime_cluster").agg(F.array(*[F.avg(F.get(regimes.POINT, i)) for i in range(len(REGIME))]).alias("m")).collect()}
    still = F.lit([int(j in means and max(abs(x - y) for x, y in zip(means[j], centre)) < 1e-2) for j, centre in enumerate(centres)])
    near = regimes.distances(centres)
    own = F.get(near, F.col("regime_cluster"))
    return told.select(SITE, TS, (own <= F.array_min(near)).cast("int").alias("with_nearest"), F.get(still, F.col("regime_cluster")).alias("centre_is_mean"))


@query("M09_hourly_models")
def hourly_models(spark, sf):
    train, val = _halves(spark, sf)
    return boosting.hourly_models(train, val, features=INPUTS, target=TARGET).select(SITE, TS, TARGET, "hourly_pred")


@query("M09_hourly_checks", _checks_sql("day(ts) > 20"))
def hourly_checks(spark, sf):
    return _checked(settle(hourly_models(spark, sf)), "hourly_pred")


@query("M10_noisy_median")
def noisy_median(spark, sf):
    train, val = _halves(spark, sf)
    models = boosting.fit_band_ensemble(train, val, features=INPUTS, target=TARGET)
    return boosting.noisy_median(models, val)


@query("M10_noise_checks", _checks_sql("day(ts) > 20"))
def noise_checks(spark, sf):
    told = settle(noisy_median(spark, sf))
    return _checked(_halves(spark, sf)[1].join(told, [SITE, TS]), "median_pred")


_ARRIVAL = "least(3, CAST(floor((day(ts)-1)/8.0e0) AS BIGINT)) + CASE WHEN (day(ts)*24+hour(ts))%7 = 3 THEN 2 ELSE 0 END"


def _arrival():
    """The trigger a row arrives in: one for each eight days, and every seventh hour two triggers late."""
    return (F.least(F.lit(3), F.floor((F.dayofmonth(TS) - 1) / 8.0)) + F.when((F.dayofmonth(TS) * 24 + F.hour(TS)) % 7 == 3, 2).otherwise(0)).cast("int")


#: A trigger drops what the watermark of the trigger before it has passed: 48 hours before the latest hour two triggers ago.
def _passed(rows: str) -> str:
    return f"""tops AS (SELECT batch, max(ts) AS top FROM {rows} GROUP BY batch),
     marks AS (SELECT b.batch, max(t.top)-INTERVAL 48 HOUR AS mark FROM tops b LEFT JOIN tops t ON t.batch < b.batch-1 GROUP BY b.batch)"""


def _replayed(spark, df, batches):
    return feeds.replayed(settle(df.withColumn(TS, F.col(TS).cast("timestamp"))), "_batch", range(batches))


@query("T01_clean_stream", _ODD + f""", arrived AS (SELECT *, {_ARRIVAL} AS batch FROM rs),
     """ + _passed("arrived") + " SELECT " + cols({"power_mw": "power_mw"}, {"target_in_range": "CASE WHEN power_mw BETWEEN 0 AND 90.09e0 THEN 1 ELSE 0 END"}, keys="site_id, CAST(ts AS VARCHAR) AS ts, reason AS impossible_reason")
       + " FROM arrived JOIN marks USING (batch) WHERE mark IS NULL OR ts > mark")
def clean_stream(spark, sf):
    """Seven triggers; some rows arrive later than they are waited for, others come again in the next trigger."""
    o = odd(spark, sf).withColumn("_batch", _arrival())
    again = o.filter(F.col("snowfall") > 0.5).withColumn("_batch", F.col("_batch") + 1)
    out = feeds.run_available(feeds.clean_readings(_replayed(spark, o.unionByName(again), 7), delay="48 hours"))
    return out.select(SITE, TS, "impossible_reason", TARGET, "target_in_range")


@query("T02_window_stream", with_(HOURLY, f"arrived AS (SELECT *, {_ARRIVAL} AS batch FROM hourly)", _passed("arrived"),
       """x AS (SELECT site_id, ts-k*INTERVAL 1 HOUR AS s, wind_speed_120m AS w FROM arrived JOIN marks USING (batch), range(6) r(k)
     WHERE mark IS NULL OR ts-k*INTERVAL 1 HOUR+INTERVAL 6 HOUR > mark)""") + "SELECT " + cols({"mean": "avg(w)", "std": "CASE WHEN count(w) > 1 THEN stddev_samp(w) ELSE 0 END"}, {"n": "count(w)"},
       keys="site_id, CAST(s AS VARCHAR) AS window_start, CAST(s+INTERVAL 6 HOUR AS VARCHAR) AS window_end") + " FROM x GROUP BY site_id, s")
def window_stream(spark, sf):
    """Six triggers; a late row counts only in the windows that are still open."""
    h = hourly(spark, sf).select(SITE, TS, "wind_speed_120m").withColumn("_batch", _arrival())
    return feeds.run_available(feeds.window_statistics(_replayed(spark, h, 6), "wind_speed_120m", delay="48 hours"), keys=[SITE, "window_start", "window_end"])



@query("T03_level_stream", with_(HOURLY, feed_cte("reanalysis"), f"""z AS (SELECT h.site_id, h.ts, h.wind_speed_120m-e.wind_speed_100m AS b, {_ARRIVAL.replace("ts", "h.ts")} AS batch
     FROM hourly h LEFT JOIN reanalysis e USING (site_id, ts))""", """tops AS (SELECT site_id, batch, max(ts) AS top FROM z GROUP BY site_id, batch)""",
     """seen AS (SELECT z.*, (SELECT max(top) FROM tops t WHERE t.site_id = z.site_id AND t.batch < z.batch) AS before, max(ts) OVER (PARTITION BY site_id) AS last FROM z)""",
     """told AS (SELECT *, coalesce(ts <= before-INTERVAL 48 HOUR, false) AS late FROM seen)""",
     """y AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS i FROM told WHERE NOT late AND ts <= last-INTERVAL 48 HOUR)""",
     """f AS (SELECT site_id, CAST(0 AS BIGINT) AS i, 0.0e0 AS x, 1.0e0 AS p FROM y WHERE i = 1 UNION ALL
     SELECT y.site_id, y.i, CASE WHEN y.b IS NULL THEN f.x ELSE f.x+(f.p+1e-4)/(f.p+1e-4+0.5e0)*(y.b-f.x) END, CASE WHEN y.b IS NULL THEN f.p+1e-4 ELSE (1-(f.p+1e-4)/(f.p+1e-4+0.5e0))*(f.p+1e-4) END
     FROM f JOIN y ON y.site_id = f.site_id AND y.i = f.i+1)""", recursive=True)
       + "SELECT " + cols({"bias": "b", "level": "x"}, {"late": "0"}) + " FROM y JOIN f USING (site_id, i) UNION ALL SELECT " + cols({"bias": "b", "level": "NULL"}, {"late": "1"}) + " FROM told WHERE late")
def level_stream(spark, sf):
    """Six triggers; every seventh hour arrives two triggers late, most of these more than the 48 hours rows are waited for."""
    h = with_feed(spark, sf, hourly(spark, sf), "era5")
    b = h.select(SITE, TS, (F.col("wind_speed_120m") - F.col("era5_wind_speed_100m")).alias("bias"), _arrival().alias("_batch"))
    with feeds.ordered_state(spark):
        out = feeds.run_available(feeds.filter_levels(_replayed(spark, b, 6), delay=dt.timedelta(hours=48)))
    return out.withColumn("late", F.col("late").cast("int"))
