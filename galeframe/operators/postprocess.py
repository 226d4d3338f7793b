"""Forecast corrections, calibration, blending and limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.config import CAPACITY_MW, DEFAULT, SITE, TS, FarmConfig
from galeframe.functions.nullsafe import bin_left_closed, clip, div, zero_if_null
from galeframe.operators.isotonic import apply_isotonic, fit_isotonic, segments
from galeframe.operators.settle import settle

c = F.col

# The published biases (MW) and strengths of the regime correction.
HIGH_WIND_BIAS, CUT_OUT_BIAS, SEASON_BIAS = -2.056, -12.976, -0.828
STRENGTHS = (0.7, 0.5, 0.7)


def regime_shift(pred: Column, ws: Column, strengths: tuple[float, float, float] = STRENGTHS,
                 biases: tuple[float, float, float] = (HIGH_WIND_BIAS, CUT_OUT_BIAS, SEASON_BIAS)) -> Column:
    """Prediction plus the weighted bias of its wind regime and of the season, before limits."""
    high, out, season = (b * w for b, w in zip(biases, strengths))
    step = F.when((ws >= 12) & (ws < 18), F.lit(high)).when(ws >= 18, F.lit(out)).otherwise(F.lit(0.0))
    return pred + step + season


def regime_bias_correction(df: DataFrame, *, pred: str, wind: str, out: str = "corrected_mw", default_wind: float = 8.0,
                           strengths: tuple[float, float, float] = STRENGTHS,
                           biases: tuple[float, float, float] = (HIGH_WIND_BIAS, CUT_OUT_BIAS, SEASON_BIAS),
                           cfg: FarmConfig = DEFAULT) -> DataFrame:
    """A missing wind counts as ``default_wind``."""
    shifted = regime_shift(c(pred), zero_if_null(wind, default_wind), strengths, biases)
    return df.withColumns({"_shifted": shifted}).withColumns({out: clip("_shifted", 0.0, cfg.capacity_mw)}).drop("_shifted")


# Bins of the shrunken bias tables and of the additive calibration.
BIAS_WIND_EDGES = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 25, 100)
BIAS_HOUR_EDGES = (0, 4, 8, 12, 16, 20, 24)
CALIBRATION_EDGES = (0, 3, 5, 7, 8, 9, 10, 11, 12, 14, 16, 25)


def leave_fold_out_bias(df: DataFrame, bins: Mapping[str, Column], *, pred: str, target: str, fold: str = "fold",
                        keys: Sequence[str] = (SITE,), min_rows: int, shrink: float) -> DataFrame:
    """Mean error of all other folds per (bin table, bin), for each fold.

    One aggregation to (bin, fold) sums; other folds = total minus own. The
    window then sees one row per fold.
    """
    item = F.array(*[F.struct(F.lit(n).alias("table"), e.alias("bin")) for n, e in bins.items()])
    long = df.select(*keys, fold, (c(target) - c(pred)).alias("_err"), F.explode(item).alias("_b")).select(
        *keys, fold, "_err", c("_b.table").alias("table"), c("_b.bin").alias("bin")).filter(c("bin").isNotNull())
    sums = long.groupBy(*keys, "table", "bin", fold).agg(F.sum("_err").alias("_s"), F.count("_err").alias("_n"))
    w = Window.partitionBy(*keys, "table", "bin")
    others = sums.withColumns({"_so": F.sum("_s").over(w) - c("_s"), "n_other": F.sum("_n").over(w) - c("_n")})
    weight = c("n_other") / (c("n_other") + float(shrink))
    value = F.when(c("n_other") < min_rows, F.lit(0.0)).otherwise(div("_so", "n_other") * weight)
    return settle(others.select(*keys, "table", "bin", fold, "n_other", value.alias("correction")))


def _with_bin_value(df: DataFrame, table: DataFrame, name: str, bin_expr: Column, out: str, fold: str, keys: Sequence[str]) -> DataFrame:
    part = table.filter(c("table") == name).select(*keys, fold, c("bin").alias("_bin"), c("correction").alias(out))
    joined = df.withColumn("_bin", bin_expr).join(part, [*keys, fold, "_bin"], "left").drop("_bin")
    return joined.withColumns({out: zero_if_null(out)})


def shrunken_bias_correction(df: DataFrame, *, pred: str, target: str, wind: str = "ws_120", ts: str = TS, fold: str = "fold",
                             keys: Sequence[str] = (SITE,), shrink: float = 30.0, out: str = "corrected_mw",
                             cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Wind, hour and month corrections learned on the other folds; hour and month enter with half and 0.3
    strength and only raise the forecast."""
    bins = {"wind": bin_left_closed(wind, BIAS_WIND_EDGES, clamp=False), "hour": bin_left_closed(F.hour(ts), BIAS_HOUR_EDGES, clamp=False),
            "month": F.month(ts)}
    table = leave_fold_out_bias(df, bins, pred=pred, target=target, fold=fold, keys=keys, min_rows=5, shrink=shrink)
    for name, e in bins.items():
        df = _with_bin_value(df, table, name, e, f"{name}_correction", fold, keys)
    df = df.withColumns({"_p": c(pred) + c("wind_correction")}).withColumns({"_p": clip("_p", 0.0, cfg.capacity_mw)})
    for name, strength in (("hour", 0.5), ("month", 0.3)):
        lift = clip(f"{name}_correction", 0.0, cfg.capacity_mw) * strength
        df = df.withColumns({"_p": c("_p") + lift}).withColumns({"_p": clip("_p", 0.0, cfg.capacity_mw)})
    return df.withColumnRenamed("_p", out)


def additive_calibration(df: DataFrame, *, pred: str, target: str, wind: str = "ws_120", fold: str = "fold", keys: Sequence[str] = (SITE,),
                         min_rows: int = 10, out: str = "calibrated_mw", upper: float | None = None) -> DataFrame:
    """Mean error of the other folds by wind bin, without shrinkage; the upper limit defaults to 1.5 times the
    fold's largest prediction."""
    bins = {"wind": bin_left_closed(wind, CALIBRATION_EDGES, clamp=True)}
    table = leave_fold_out_bias(df, bins, pred=pred, target=target, fold=fold, keys=keys, min_rows=min_rows, shrink=0.0)
    df = _with_bin_value(df, table, "wind", bins["wind"], "wind_correction", fold, keys)
    if upper is None:
        top = settle(df.groupBy(*keys, fold).agg((F.max(pred) * 1.5).alias("_top")))
        df = df.join(top, [*keys, fold], "left")
    else:
        df = df.withColumn("_top", F.lit(float(upper)))
    df = df.withColumns({"_p": c(pred) + c("wind_correction")})
    return df.withColumns({out: clip("_p", 0.0, c("_top"))}).drop("_p", "_top")


def bias_shifts(df: DataFrame, *, pred: str, target: str, calibration: Column, wind: str = "ws_120", shrink: float = 30.0,
                keys: Sequence[str] = (SITE,)) -> DataFrame:
    """Per key: the overall mean error, and shrunken mean errors of the calibration rows at high wind and past cut-out."""
    err = c(target) - c(pred)
    out = df.groupBy(*keys).agg(F.avg(err).alias("global_bias"), *[
        a for name, cond in (("high", (c(wind) >= 12) & (c(wind) < 18)), ("cutout", c(wind) >= 18))
        for a in (F.avg(F.when(calibration & cond, err)).alias(f"_{name}"), F.count_if(calibration & cond).alias(f"n_{name}"))])
    shrunk = {f"{name}_bias": F.when(c(f"n_{name}") > 10, c(f"_{name}") * c(f"n_{name}") / (c(f"n_{name}") + float(shrink))).otherwise(F.lit(0.0))
              for name in ("high", "cutout")}
    return settle(out.withColumns(shrunk).drop("_high", "_cutout"))


def apply_bias_shifts(df: DataFrame, shifts: DataFrame, *, pred: str, wind: str = "ws_120", keys: Sequence[str] = (SITE,),
                      cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Two corrected columns: the global shift, and the high-wind shift."""
    joined = df.join(shifts.select(*keys, "global_bias", "high_bias", "cutout_bias"), list(keys), "left")
    ws = c(wind)
    step = F.when((ws >= 12) & (ws < 18), c("high_bias")).when(ws >= 18, c("cutout_bias")).otherwise(F.lit(0.0))
    joined = joined.withColumns({"_g": c(pred) + c("global_bias"), "_h": c(pred) + step})
    return joined.withColumns({"global_shifted_mw": clip("_g", 0.0, cfg.capacity_mw), "wind_shifted_mw": clip("_h", 0.0, cfg.capacity_mw)}).drop(
        "_g", "_h", "global_bias", "high_bias", "cutout_bias")


def isotonic_recalibration(df: DataFrame, *, pred: str, target: str, folds: Sequence[int], fold: str = "fold", keys: Sequence[str] = (SITE,),
                           min_rows: int = 100, out: str = "recalibrated_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Each fold is mapped by the isotonic curve of all other folds.

    Every row takes part in one fit per other fold; ``folds`` is the short list
    of fold numbers.
    """
    others = F.filter(F.array(*[F.lit(f).cast("long") for f in folds]), lambda f: f != c(fold))
    spread = df.select(*keys, pred, target, F.explode(others).alias("_held_out"))
    curve_keys = [*keys, "_held_out"]
    curve = settle(fit_isotonic(spread, curve_keys, pred, target, fit_filter=c(target) >= 0, min_rows=min_rows, y_max=cfg.capacity_mw))
    rows = df.withColumn("_held_out", c(fold).cast("long"))
    return apply_isotonic(rows, segments(curve, curve_keys), curve_keys, {out: pred}).drop("_held_out")


def recalibration_table(df: DataFrame, *, before: str, after: str, target: str, fold: str = "fold", cfg: FarmConfig = DEFAULT) -> DataFrame:
    from galeframe.operators.evaluate import nmae

    out = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), nmae(target, before, cfg).alias("before_nmae_pct"), nmae(target, after, cfg).alias("after_nmae_pct"))
    return out.withColumns({"delta_pp": c("after_nmae_pct") - c("before_nmae_pct")})


def fit_affine(df: DataFrame, keys: Sequence[str], *, pred: str, target: str, min_rows: int, slope_range: tuple[float, float] | None = None,
               clip_slope: tuple[float, float] | None = None, clip_offset: tuple[float, float] | None = None) -> DataFrame:
    """Least-squares slope and offset per key; too few rows or a slope outside ``slope_range`` gives identity."""
    both = c(pred).isNotNull() & c(target).isNotNull()
    fit = df.filter(both).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(target, pred).alias("_a"), F.regr_intercept(target, pred).alias("_b"))
    ok = (c("n") >= min_rows) & c("_a").isNotNull() & c("_b").isNotNull()
    if slope_range is not None:
        ok = ok & c("_a").between(*slope_range)
    a = c("_a") if clip_slope is None else clip("_a", *clip_slope)
    b = c("_b") if clip_offset is None else clip("_b", *clip_offset)
    return settle(fit.select(*keys, "n", F.when(ok, a).otherwise(F.lit(1.0)).alias("slope"), F.when(ok, b).otherwise(F.lit(0.0)).alias("offset")))


def fit_month_affine(df: DataFrame, *, pred: str, target: str, month: str = "month", keys: Sequence[str] = (), min_rows: int = 200) -> DataFrame:
    return fit_affine(df, [*keys, month], pred=pred, target=target, min_rows=min_rows, slope_range=(0.5, 1.5))


def apply_affine(df: DataFrame, params: DataFrame, keys: Sequence[str], *, pred: str, out: str, limit: FarmConfig | None = None) -> DataFrame:
    joined = df.join(params.select(*keys, "slope", "offset"), list(keys), "left")
    value = zero_if_null("slope", 1.0) * c(pred) + zero_if_null("offset")
    joined = joined.withColumns({out: value}).drop("slope", "offset")
    return joined if limit is None else joined.withColumns({out: clip(out, 0.0, limit.capacity_mw)})


# Wind regimes of the affine calibration.
AFFINE_EDGES = (0.0, 3.0, 7.0, 12.0, 17.0, 99.0)


def regime_affine(df: DataFrame, *, pred: str, target: str, wind: str = "ws_120", keys: Sequence[str] = (), fit_filter: Column | None = None,
                  out: str = "affine_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Clipped affine map per wind regime; rows outside the regimes keep their prediction."""
    tagged = df.withColumn("_regime", bin_left_closed(wind, AFFINE_EDGES, clamp=False))
    rows = tagged if fit_filter is None else tagged.filter(fit_filter)
    params = fit_affine(rows.filter(c("_regime").isNotNull()), [*keys, "_regime"], pred=pred, target=target, min_rows=30,
                        clip_slope=(0.7, 1.3), clip_offset=(-10.0, 10.0))
    done = apply_affine(tagged, params, [*keys, "_regime"], pred=pred, out="_mapped", limit=cfg)
    return done.withColumns({out: F.when(c("_regime").isNull(), c(pred)).otherwise(c("_mapped"))}).drop("_regime", "_mapped")


def _abs_error(target: str, blend: Column, capacity: float) -> Column:
    limited = F.greatest(F.lit(0.0), F.least(F.lit(capacity), blend))
    return F.abs(c(target) - limited)


def scan_weights(df: DataFrame, candidates: Mapping[str, Column], *, target: str, keys: Sequence[str] = (), capacity: float = CAPACITY_MW) -> DataFrame:
    """nMAE of every candidate per key, all in one aggregation, with the best one marked (first of equals)."""
    names = list(candidates)
    aggs = [(F.avg(_abs_error(target, e, capacity)) / capacity * 100.0).alias(f"_e{i}") for i, e in enumerate(candidates.values())]
    wide = df.groupBy(*keys).agg(*aggs)
    pairs = ", ".join(f"{i}L, '{n}', _e{i}" for i, n in enumerate(names))
    best = F.least(*[c(f"_e{i}") for i in range(len(names))]) if len(names) > 1 else c("_e0")
    first = F.array_position(F.array(*[c(f"_e{i}") for i in range(len(names))]), best) - 1
    long = wide.withColumns({"_best": first}).select(*keys, "_best", F.expr(f"stack({len(names)}, {pairs}) AS (position, candidate, nmae_pct)"))
    return long.withColumns({"is_best": c("position") == c("_best")}).drop("_best")


def blend_grid(first: str, second: str, *, steps: int = 20) -> dict[str, Column]:
    """Weights 0, 1/steps ... 1 of the second leg."""
    return {f"{i / steps:.2f}": (i / steps) * c(second) + (1.0 - i / steps) * c(first) for i in range(steps + 1)}


def simplex_grid(legs: Sequence[str], *, steps: int = 10) -> dict[str, Column]:
    """All weight vectors on a grid that add up to one."""
    out = {}
    for head in product(range(steps + 1), repeat=len(legs) - 1):
        rest = steps - sum(head)
        if rest < 0:
            continue
        weights = [*head, rest]
        blend = None
        for w, leg in zip(weights, legs):
            term = (w / steps) * c(leg)
            blend = term if blend is None else blend + term
        out["/".join(str(w) for w in weights)] = blend
    return out


def fold_weighted_mean(df: DataFrame, weights: Mapping[int, float], *, pred: str, keys: Sequence[str] = (SITE, TS), fold: str = "fold", out: str = "pred_mw") -> DataFrame:
    """Weighted sum of each row's predictions over the folds' models."""
    w = F.lit(None).cast("double")
    for f, value in weights.items():
        w = F.when(c(fold) == f, F.lit(float(value))).otherwise(w)
    return df.groupBy(*keys).agg(F.sum(w * c(pred)).alias(out))


def icing_derate(df: DataFrame, *, pred: str, out: str = "derated_mw", classic: float = 0.90, rime: float = 0.92, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Reduce forecasts in freezing precipitation, and a little less between 0 and 2 degrees."""
    t, precip = c("temperature_80m"), c("rain") + c("showers") + c("snowfall")
    factor = F.when((t < 0) & (precip > 0), F.lit(classic)).when((t >= 0) & (t < 2) & (precip > 0), F.lit(rime)).otherwise(F.lit(1.0))
    return df.withColumns({"_d": c(pred) * factor}).withColumns({out: clip("_d", 0.0, cfg.capacity_mw)}).drop("_d")


def cut_limits(df: DataFrame, *, pred: str, wind: str = "v_eff", cut_in: float = 3.0, cut_out: float = 25.0, center: float = 2.6, width: float = 1.2,
               cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Hard cut-in with a 5 MW limit past cut-out, and the soft cut-in."""
    v = c(wind)
    hard = F.when(v < cut_in, F.lit(0.0)).when(v > cut_out, F.least(c(pred), F.lit(5.0))).otherwise(c(pred))
    soft = c(pred) / (1.0 + F.exp((v - center) * (-4.0 / width)))
    return df.withColumns({"_h": hard, "_s": soft}).withColumns(
        {"hard_limited_mw": clip("_h", 0.0, cfg.capacity_mw), "soft_limited_mw": clip("_s", 0.0, cfg.capacity_mw)}).drop("_h", "_s")


# Forecast share by hour ahead while blending with the last measurement.
PERSISTENCE_SHARES = {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.7}


def persistence_blend(horizon: DataFrame, history: DataFrame, *, pred: str, target: str, out: str = "blended_mw", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Blend the first hours of the day with the site's last measured power."""
    last = settle(history.filter(c(target).isNotNull()).groupBy(SITE).agg(F.max_by(target, TS).alias("_last")))
    share = F.lit(1.0)
    for h, s in PERSISTENCE_SHARES.items():
        share = F.when(F.hour(TS) == h, F.lit(s)).otherwise(share)
    joined = horizon.join(last, SITE, "left").withColumns({"_base": clip(pred, 0.0, cfg.capacity_mw), "_share": share})
    mixed = F.when(c("_last").isNull(), c("_base")).otherwise(c("_share") * c("_base") + (1.0 - c("_share")) * c("_last"))
    return joined.withColumns({out: mixed}).drop("_last", "_base", "_share")


def conditional_bias(df: DataFrame, *, pred: str, target: str, wind: str = "ws_120", ts: str = TS) -> DataFrame:
    """Mean error by wind class, first quarter, day and night, and month; one pass."""
    ws, hour = c(wind), F.hour(ts)
    night = (hour >= 20) | (hour <= 3)
    wind_class = F.when(ws < 4, "calm").when(ws < 8, "low").when(ws < 12, "mid").when(ws < 18, "high").when(ws < 100, "cutout")
    labels = [("all", F.lit("all")), ("wind", wind_class), ("season", F.when(F.month(ts) <= 3, F.lit("q1"))), ("day", F.when(night, "night").otherwise("day")),
              ("month", F.month(ts).cast("string"))]
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.alias("label")) for n, e in labels])
    long = df.select((c(target) - c(pred)).alias("_err"), F.explode(item).alias("_g"))
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.label").alias("label")).agg(
        F.count("_err").alias("n"), F.avg("_err").alias("bias")).filter(c("label").isNotNull())


def strength_grid(pred: str, wind: str, *, levels: Sequence[float] = (0.0, 0.3, 0.5, 0.7, 1.0),
                  biases: tuple[float, float, float] = (HIGH_WIND_BIAS, CUT_OUT_BIAS, SEASON_BIAS)) -> dict[str, Column]:
    """The regime correction at every combination of strengths; the regime tests are shared by all of them."""
    high = ((c(wind) >= 12) & (c(wind) < 18)).cast("double")
    past = (c(wind) >= 18).cast("double")
    return {"/".join(f"{s:g}" for s in (a, b, s)): c(pred) + high * (biases[0] * a) + past * (biases[1] * b) + biases[2] * s
            for a, b, s in product(levels, repeat=3)}


def forecast_path(forecast: DataFrame, history: DataFrame, weather: DataFrame, *, pred: str, wind: str, target: str, analog_share: float = 0.07, out: str = "forecast_mw",
                  cfg: FarmConfig = DEFAULT) -> DataFrame:
    """From raw predictions to the submitted forecast: regime correction, analog blend, smoothing in time order, limits, position.

    ``weather`` holds the scoring hours' weather for the analog search in ``history``; hours without analogs keep the
    corrected value.
    """
    from galeframe.operators.analogs import analog_forecast
    from galeframe.operators.smoothing import quadratic_smooth
    from galeframe.sources.readers import scoring_table

    corrected = regime_bias_correction(forecast.select(SITE, TS, pred, wind), pred=pred, wind=wind, out="_corrected", cfg=cfg)
    analogs = analog_forecast(history, weather, target=target, cfg=cfg).select(SITE, TS, "analog_quantile_mw")
    blend = (1.0 - analog_share) * c("_corrected") + analog_share * F.coalesce("analog_quantile_mw", "_corrected")
    blended = corrected.join(analogs, [SITE, TS], "left").withColumns({"_blend": blend}).select(SITE, TS, "_blend")
    return scoring_table(quadratic_smooth(blended, pred="_blend", out=out, cfg=cfg)).drop("_blend")
