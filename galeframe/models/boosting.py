"""Model-shaped jobs: boosted trees grown by ``histogram``, ridge stacks from sums, clusters by ``regimes``.

The trees stand in for single-machine boosters, so fitted numbers differ from those by design; weights, folds, seeds, early
stopping and averaging follow the same recipe. All models of a job grow side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from galeframe.config import DEFAULT, SITE, TS, FarmConfig
from galeframe.functions.nullsafe import clip, zero_if_null
from galeframe.models.histogram import Models, Settings, Trees, fit_models, prediction_of
from galeframe.models.regimes import cluster
from galeframe.operators.cleaning import BANDS
from galeframe.operators.evaluate import nmae
from galeframe.operators.settle import settle

c = F.col


def band_weights(wind: str, bands: Mapping[str, tuple[float, float]], seeds: Sequence[int], *, base: Column, inside: float, outside: float, rows: float) -> list[Column]:
    """Row weights of one model for each band and seed: each band weighs its own rows up, each seed draws its share of the rows."""
    out = []
    for lo, hi in bands.values():
        band = F.when((c(wind) >= lo) & (c(wind) < hi), F.lit(inside)).otherwise(F.lit(outside)) * base
        out += [F.when(F.pmod(F.xxhash64(SITE, TS, F.lit(s)), F.lit(1000)) < int(1000 * rows), band).otherwise(0.0) for s in seeds]
    return out


def averaged(models: Models, chosen: Sequence[int] | None = None) -> Column:
    """Mean prediction of the fitted models among ``chosen``."""
    some = [m for m in (chosen if chosen is not None else range(len(models.trees))) if models.fitted[m]]
    all_of = models.predictions()
    return F.aggregate(F.array(*[F.get(all_of, m) for m in some]), F.lit(0.0), lambda a, x: a + x) / float(len(some)) if some else F.lit(None).cast("double")


def fit_band_ensemble(train: DataFrame, val: DataFrame, *, features: Sequence[str], target: str, wind: str = "wind_speed_120m", weight: str | None = None,
                      seeds: Sequence[int] = (42, 7, 123, 2024, 99), bands: Mapping[str, tuple[float, float]] = BANDS, inside: float = 2.0, outside: float = 0.3,
                      rows: float = 0.8, settings: Settings = Settings()) -> Models:
    """One model per wind band and seed, stopped early on the validation rows; all grow from the same passes."""
    base = F.lit(1.0) if weight is None else c(weight)
    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)), allowMissingColumns=True)
    weights = [F.when(~c("_val"), w) for w in band_weights(wind, bands, seeds, base=base, inside=inside, outside=outside, rows=rows)]
    judged = [F.when(c("_val"), F.lit(1.0))] * len(weights)
    return fit_models(both, features=features, target=c(target), weights=weights, judged=judged, seeds=list(seeds) * len(bands), settings=settings)


def predict_ensemble(models: Models, df: DataFrame, *, out: str) -> DataFrame:
    return df.withColumn(out, averaged(models))


def cross_validated_bag(df: DataFrame, score: DataFrame, *, folds: Sequence[int], features: Sequence[str], target: str, fold: str = "fold", wind: str = "wind_speed_120m",
                        seeds: Sequence[int] = (42, 7), bands: Mapping[str, tuple[float, float]] = BANDS, inside: float = 2.0, outside: float = 0.3, rows: float = 0.8,
                        keep: Sequence[str] = (SITE, TS), settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Walk-forward bag: each fold is predicted by models of the rows before it, scored rows by the mean over folds.

    Fold numbers grow with time, so training uses the smaller numbers only. The models of all folds, bands and seeds grow
    from the same passes. A fold without rows before it has no prediction.
    """
    one = band_weights(wind, bands, seeds, base=F.lit(1.0), inside=inside, outside=outside, rows=rows)
    weights = [F.when(c(fold) < f, w) for f in folds for w in one]
    judged = [F.when(c(fold) == f, F.lit(1.0)) for f in folds for _ in one]
    models = fit_models(df, features=features, target=c(target), weights=weights, judged=judged, seeds=list(seeds) * (len(bands) * len(folds)), settings=settings)
    of = {f: averaged(models, range(i * len(one), (i + 1) * len(one))) for i, f in enumerate(folds)}
    own = F.lit(None).cast("double")
    for f, mean in of.items():
        own = F.when(c(fold) == f, mean).otherwise(own)
    held = df.filter(c(fold).isin(*folds)).select(fold, *keep, target, own.alias("raw_pred"))
    scored = score.select(*keep, *[mean.alias(f"test_fold{f}") for f, mean in of.items()])
    names = [f"test_fold{f}" for f in folds]
    there = F.filter(F.array(*names), lambda x: x.isNotNull())
    return held, scored.withColumn("test_mean", F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0)))


def top_features(df: DataFrame, *, features: Sequence[str], target: str, k: int, fold_weights: Mapping[int, float] | None = None, fold: str = "fold",
                 seed: int = 42, settings: Settings = Settings(features=1.0)) -> DataFrame:
    """Features by share of gain in a probe fit, or by the weighted mean over one probe per fold, trained on the rows before it and
    stopped early on it; the probes grow side by side. The list is one row per feature."""
    probes = {None: 1.0} if fold_weights is None else dict(fold_weights)
    weights = [F.lit(1.0) if f is None else F.when(c(fold) < f, F.lit(1.0)) for f in probes]
    judged = [F.lit(0.0) if f is None else F.when(c(fold) == f, F.lit(1.0)) for f in probes]
    models = fit_models(df, features=features, target=c(target), weights=weights, judged=judged, seeds=[seed] * len(probes), settings=settings)
    total = sum(w * models.importance(m) for m, w in enumerate(probes.values()))
    table = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(features, total)], "feature string, importance double")
    return table.orderBy(c("importance").desc(), "feature").limit(k)


def fit_residual_ensemble(train: DataFrame, val: DataFrame, *, features: Sequence[str], target: str, baseline: str, mid_band: tuple[float, float] | None = None, **kwargs) -> Models:
    """The band ensemble on target minus baseline; ``mid_band`` keeps only the rows of that wind band in play."""
    rows = [d.withColumns({"_residual": c(target) - c(baseline)}) for d in (train, val)]
    if mid_band is not None:
        kwargs |= {"bands": {"mid": mid_band}, "inside": 1.0, "outside": 0.0}
    return fit_band_ensemble(*rows, features=features, target="_residual", **kwargs)


def predict_residual(models: Models, df: DataFrame, *, baseline: str, out: str, cfg: FarmConfig = DEFAULT) -> DataFrame:
    done = predict_ensemble(models, df, out="_r").withColumns({"_sum": c(baseline) + c("_r")})
    return done.withColumns({out: clip("_sum", 0.0, cfg.capacity_mw)}).drop("_r", "_sum")


def area_under_curve(df: DataFrame, *, score: str, label: str, by: str, cells: int = 4096) -> DataFrame:
    """Exact area under the ROC curve per group: the chance that a row of label 1 scores above one of label 0, ties by half.

    Equal scores are counted first. Counts per cell of the score range give every cell the rows of label 0 below it; only the
    distinct scores of a cell are then ordered. Rows without score or label take no part; a group of one label has none.
    """
    at = df.filter(c(score).isNotNull() & ~F.isnan(c(score).cast("double")) & c(label).isNotNull()).groupBy(c(by).alias("_g"), c(score).cast("double").alias("_s")).agg(
        F.sum((c(label) == 1).cast("long")).alias("_one"), F.sum((c(label) == 0).cast("long")).alias("_zero"))
    ends = at.groupBy("_g").agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    share = F.when(c("_high") > c("_low"), (c("_s") - c("_low")) / (c("_high") - c("_low"))).otherwise(0.0)
    at = settle(at.join(ends, at["_g"].eqNullSafe(ends["_g"])).drop(ends["_g"]).withColumn("_cell", F.least(F.lit(cells - 1), F.floor(share * cells)).cast("int")))
    cell = at.groupBy("_g", "_cell").agg(F.sum("_zero").alias("_in"))
    cell = cell.withColumn("_below", F.sum("_in").over(W.Window.partitionBy("_g").orderBy("_cell")) - c("_in")).withColumnsRenamed({"_g": "_cg", "_cell": "_cc"})
    inside = W.Window.partitionBy("_g", "_cell").orderBy("_s")
    ranked = at.withColumn("_before", F.sum("_zero").over(inside) - c("_zero"))
    met = ranked.join(cell, ranked["_g"].eqNullSafe(c("_cg")) & (ranked["_cell"] == c("_cc")))
    pairs = F.sum(c("_one") * (c("_below") + c("_before")).cast("double") + c("_one") * c("_zero").cast("double") * 0.5)
    ones, zeros = F.sum("_one"), F.sum("_zero")
    return met.groupBy(c("_g").alias(by)).agg(F.when((ones > 0) & (zeros > 0), pairs / (ones.cast("double") * zeros)).alias("auc"))


def time_blocks(df: DataFrame, n: int, *, out: str = "_cv") -> DataFrame:
    """Blocked folds: the span of time cut into ``n`` equal stretches."""
    low, high = df.agg(F.min(TS), F.max(TS)).select(*[F.unix_micros(c(x).cast("timestamp")).alias(y) for x, y in (("min(ts)", "a"), ("max(ts)", "b"))]).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // n))
    return df.withColumn(out, F.floor((F.unix_micros(c(TS).cast("timestamp")) - F.lit(low or 0)) / F.lit(width)).cast("int"))


def train_or_score(train: DataFrame, score: DataFrame, *, features: Sequence[str], n_folds: int = 5, seed: int = 42, removal_rounds: int = 1, give_away: float = 0.9,
                   settings: Settings = Settings(loss="logistic", features=1.0)) -> tuple[DataFrame, DataFrame, list[tuple[int, float, str | None]]]:
    """How well rows can be told apart as training or scoring rows: AUC per fold, and held-out probabilities.

    Training rows and scoring rows are each cut into ``n_folds`` stretches of time; the models of all folds grow side by side.
    While the mean AUC is at least ``give_away``, the column of the largest gain is taken out and the folds are fitted again,
    at most ``removal_rounds`` times; the third result tells (round, mean AUC, column taken out after it).
    """
    parts = [time_blocks(d, n_folds).withColumn("_label", F.lit(y)) for d, y in ((train, 0.0), (score, 1.0))]
    rows = settle(parts[0].unionByName(parts[1], allowMissingColumns=True).select(SITE, TS, "_label", "_cv", *features))
    used, told = list(features), []
    for turn in range(removal_rounds + 1):
        models = fit_models(rows, features=used, target=c("_label"), weights=[F.when(c("_cv") != f, F.lit(1.0)) for f in range(n_folds)],
                            seeds=[seed + f for f in range(n_folds)], bounds=(0.0, 1.0), settings=replace(settings, loss="logistic"))
        held = settle(rows.select(SITE, TS, "_label", "_cv", F.get(models.predictions(), c("_cv")).alias("av_prob")))
        table = area_under_curve(held, score="av_prob", label="_label", by="_cv")
        mean = table.agg(F.avg("auc")).first()[0]
        gains = sum(models.importance(f) for f in range(n_folds))
        out = used[int(np.argmax(gains))] if turn < removal_rounds and mean is not None and mean >= give_away and len(used) > 1 else None
        told.append((turn, mean, out))
        if out is None:
            break
        used.remove(out)
    return table.withColumnRenamed("_cv", "fold"), held.select(SITE, TS, c("_label").alias("is_score"), c("_cv").alias("fold"), "av_prob"), told


def probability_by_period(probs: DataFrame) -> DataFrame:
    return probs.groupBy(F.year(TS).alias("year"), F.month(TS).alias("month"), "is_score").agg(F.count(F.lit(1)).alias("n"), F.avg("av_prob").alias("mean_prob"))


@dataclass(frozen=True)
class Ridge:
    """Ridge on standardised columns; missing values count as 0, as in the merged sources."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float

    def prediction(self, cfg: FarmConfig = DEFAULT) -> Column:
        out = F.lit(self.intercept)
        for n, m, s, w in zip(self.columns, self.mean, self.scale, self.weight):
            out = out + (zero_if_null(c(n).cast("double")) - F.lit(m)) * F.lit(w / s)
        return clip(out, 0.0, cfg.capacity_mw)


@dataclass(frozen=True)
class Sums:
    """Count, sums and cross-products of columns and target; the target comes last."""

    n: float
    first: np.ndarray
    second: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)

    def ridge(self, columns: Sequence[str], alpha: float) -> Ridge:
        """Least squares with penalty ``alpha`` on the weights of the standardised columns; a constant column gets none."""
        mean = self.first / self.n
        cross = self.second - self.n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cross)[:-1], 0.0) / max(self.n - 1.0, 1.0))
        scale = np.where(spread > 0.0, spread, 1.0)
        weight = np.linalg.solve(cross[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(columns)), cross[:-1, -1] / scale)
        return Ridge(tuple(columns), tuple(map(float, mean[:-1])), tuple(map(float, scale)), tuple(map(float, weight)), float(mean[-1]))


def fold_sums(df: DataFrame, *, columns: Sequence[str], target: str, fold: str = "fold") -> dict[int, Sums]:
    """Sums per fold from one aggregation; one row per fold reaches the driver."""
    names = [zero_if_null(c(n).cast("double")) for n in columns] + [c(target).cast("double")]
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.filter(c(target).isNotNull()).groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(f"a{i}") for i, e in enumerate(names)], *[F.sum(names[i] * names[j]).alias(f"b{i}_{j}") for i, j in at]).collect()
    out = {}
    for r in rows:
        second = np.zeros((len(names), len(names)))
        for i, j in at:
            second[i, j] = second[j, i] = r[f"b{i}_{j}"]
        out[r[fold]] = Sums(float(r["n"]), np.array([r[f"a{i}"] for i in range(len(names))]), second)
    return out


def all_sums(parts: Mapping[int, Sums]) -> Sums:
    every = list(parts.values())
    return Sums(sum(p.n for p in every), sum(p.first for p in every), sum(p.second for p in every))


def fit_ridge(df: DataFrame, *, columns: Sequence[str], target: str, alpha: float, fold: str = "fold") -> Ridge:
    return all_sums(fold_sums(df, columns=columns, target=target, fold=fold)).ridge(columns, alpha)


def ridge_stack(df: DataFrame, *, columns: Sequence[str], target: str, folds: Sequence[int], alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0), fold: str = "fold",
                cfg: FarmConfig = DEFAULT) -> tuple[DataFrame, float]:
    """Leave-one-fold-out error of every penalty, and the best penalty.

    Two passes for any number of penalties: sums per fold, then the errors of all fits. The fit without a fold is solved
    from the total minus the fold.
    """
    parts = fold_sums(df, columns=columns, target=target, fold=fold)
    total = all_sums(parts)
    held = df.filter(c(fold).isin(*folds))
    for k, alpha in enumerate(alphas):
        value = F.lit(None).cast("double")
        for f in folds:
            value = F.when(c(fold) == f, (total - parts[f]).ridge(columns, alpha).prediction(cfg)).otherwise(value)
        held = held.withColumn(f"_stack{k}", value)
    errors = held.groupBy(fold).agg(*[nmae(target, f"_stack{k}", cfg).alias(f"e{k}") for k in range(len(alphas))]).collect()
    rows = [(float(a), int(r[fold]), float(r[f"e{k}"])) for k, a in enumerate(alphas) for r in errors]
    table = df.sparkSession.createDataFrame(rows, "alpha double, fold int, nmae_pct double")
    return table, min(alphas, key=lambda a: sum(e for x, _, e in rows if x == a))


def good_models(df: DataFrame, models: Sequence[str], *, target: str, below: float, cfg: FarmConfig = DEFAULT) -> list[str]:
    """Models whose nMAE is under a threshold, from one aggregation."""
    row = df.agg(*[nmae(target, m, cfg).alias(m) for m in models]).first()
    return [m for m in models if row[m] is not None and row[m] < below]


def regime_clusters(df: DataFrame, *, columns: Sequence[str] = ("hellmann_alpha", "wind_speed_120m", "air_density", "temp_gradient"), k: int = 5, seed: int = 42, out: str = "regime_cluster") -> DataFrame:
    """Rows with the number of their atmospheric regime."""
    return cluster(df, columns=columns, k=k, seed=seed, out=out)[0]


def hourly_models(train: DataFrame, val: DataFrame, *, features: Sequence[str], target: str, min_rows: int = 100, out: str = "hourly_pred", seed: int = 42,
                  settings: Settings = Settings()) -> DataFrame:
    """One model per hour of day, stopped early on that hour's validation rows; hours with too few training rows use a model of
    all hours, as ``hour_model`` tells. The 25 models grow side by side."""
    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)), allowMissingColumns=True).withColumn("_h", F.hour(TS))
    both = settle(both.select("_val", "_h", *dict.fromkeys([target, *features])))  # counted, sketched and binned
    some = F.array(*[F.sum(((c("_h") == h) & ~c("_val") & c(target).isNotNull()).cast("long")) for h in range(24)])
    counts = both.agg(some.alias("n")).first()["n"]
    enough = [(n or 0) >= min_rows for n in counts]
    mine = [c("_h") == h for h in range(24)] + [F.lit(True)]
    weights = [F.when(of & ~c("_val"), F.lit(1.0)) if h == 24 or enough[h] else F.lit(0.0) for h, of in enumerate(mine)]
    models = fit_models(both, features=features, target=c(target), weights=weights, judged=[F.when(of & c("_val"), F.lit(1.0)) for of in mine], seeds=[seed] * 25, settings=settings)
    own = F.get(F.array(*[F.lit(h if ok else None).cast("int") for h, ok in enumerate(enough)]), F.hour(TS))
    return val.withColumn("hour_model", own).withColumn(out, F.get(models.predictions(), F.coalesce("hour_model", F.lit(24))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits depend on all bits of ``x`` (a finaliser of 64-bit hashes)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(key: np.ndarray, copies: int, width: int) -> np.ndarray:
    """(rows, copies, features) standard normal numbers, fixed by the row's key, the copy and the feature."""
    def uniform(salt: int) -> np.ndarray:
        step = (np.arange(copies * width, dtype=np.uint64) * np.uint64(2) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed(key.view(np.uint64)[:, None] + step) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return (np.sqrt(-2.0 * np.log(uniform(1))) * np.cos(2.0 * np.pi * uniform(2))).reshape(len(key), copies, width)


def noisy_median(models: Models, df: DataFrame, *, copies: int = 5, scale: float = 0.01, out: str = "median_pred") -> DataFrame:
    """Median of the mean predictions of the row and ``copies`` noisy versions of it; the versions of a row are scored as one
    block, so rows do not multiply. The noise is fixed by site, time, copy and feature, so a rerun task repeats it."""
    features, width = models.features, len(models.features)
    row = df.agg(*[F.stddev_pop(c(n).cast("double")).alias(f"_{i}") for i, n in enumerate(features)]).first()
    step = np.array([scale * (row[f"_{i}"] or 0.0) for i in range(width)])
    trees, edges, loss = [vars(t) for t, ok in zip(models.trees, models.fitted) if ok], models.edges, models.loss

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fitted = [Trees(**t) for t in trees]
        for x, key in parts:
            values = np.array([np.asarray(r, float) for r in x]).reshape(-1, 1, width)
            many = np.concatenate([values, values + normal(key.to_numpy(np.int64), copies, width) * step], 1)
            told = prediction_of(many.reshape(-1, width), edges, fitted, loss).mean(1).reshape(len(x), copies + 1)
            yield pd.Series(np.median(told, 1))

    scored = F.pandas_udf(run, "double")(F.array(*[c(n).cast("double") for n in features]), F.xxhash64(SITE, TS))
    return df.select(SITE, TS, scored.alias(out), F.lit(copies + 1).cast("long").alias("n_copies"))
