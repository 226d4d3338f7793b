"""Scores, error reports by regime and diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.config import DEFAULT, SITE, TARGET, TS, FarmConfig
from galeframe.functions.curve import turbine_power_kw
from galeframe.functions.nullsafe import bin_left_closed, bin_right_closed, clip, correlation, div, evaluate_once, sector_wrapped
from galeframe.operators.ranks import percentiles

c = F.col


def _limited(pred: str | Column, cfg: FarmConfig) -> Column:
    return clip(pred, 0.0, cfg.capacity_mw)


def nmae(target: str, pred: str, cfg: FarmConfig = DEFAULT) -> Column:
    """Mean absolute error of the limited prediction in percent of capacity (an aggregate)."""
    return F.avg(F.abs(c(target) - _limited(pred, cfg))) / cfg.capacity_mw * 100.0


def scores(df: DataFrame, *, target: str, pred: str, keys: Sequence[str] = (), cfg: FarmConfig = DEFAULT) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), nmae(target, pred, cfg).alias("nmae_pct"),
                                 F.avg(F.abs(c(target) - c(pred))).alias("mae_mw"), F.avg(c(target) - c(pred)).alias("bias_mw"))


def regime_report(df: DataFrame, regimes: Mapping[str, Column], *, target: str, pred: str, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Rows, row share, local error, share of all error and bias for every regime of every grouping, in one pass.

    Each grouping is a column of labels; NULL leaves a row out of that grouping.
    """
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.cast("string").alias("regime")) for n, e in regimes.items()])
    err = c(pred) - c(target)
    long = df.select(err.alias("_e"), c(target).alias("_y"), F.explode(item).alias("_g")).select(
        "_e", "_y", c("_g.grouping").alias("grouping"), c("_g.regime").alias("regime"))
    parts = long.groupBy("grouping", "regime").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("_e")).alias("_abs"), F.sum("_e").alias("_sum"), F.avg("_y").alias("mean_target"))
    # One row per regime reaches this window.
    w = Window.partitionBy("grouping")
    return parts.withColumns({"_n_all": F.sum("n").over(w), "_abs_all": F.sum("_abs").over(w)}).filter(c("regime").isNotNull()).select(
        "grouping", "regime", "n", "mean_target", (c("n") * 100.0 / c("_n_all")).alias("share_rows_pct"),
        (c("_abs") / c("n") / cfg.capacity_mw * 100.0).alias("local_nmae_pct"), zero_share("_abs", "_abs_all").alias("share_error_pct"),
        (c("_sum") / c("n")).alias("bias_mw"), (c("_abs") / c("n")).alias("mae_mw"))


def zero_share(part: str, whole: str) -> Column:
    return F.coalesce(div(c(part) * 100.0, whole), F.lit(0.0))


# Edges of the wind regimes and of the curve report.
REGIME_EDGES = (0, 3, 7, 12, 17, 25, 1000)
CURVE_EDGES = (0, 3, 5, 7, 10, 13, 100)


def wind_label(wind: str, edges: Sequence[float]) -> Column:
    i = bin_left_closed(wind, edges, clamp=False)
    names = [f"{a}-{b}" for a, b in zip(edges[:-1], edges[1:])]
    return F.get(F.array(*[F.lit(n) for n in names]), i)


def quantile_label(value: str, cuts: Sequence[Column], names: Sequence[str]) -> Column:
    """Label by right-closed quantile bands."""
    out = F.lit(names[-1])
    for cut, name in zip(reversed(cuts), reversed(names[:-1])):
        out = F.when(c(value) <= cut, F.lit(name)).otherwise(out)
    return F.when(c(value).isNotNull(), out)


def fixed_quantiles(df: DataFrame, columns: Mapping[str, float], quantiles: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of several columns as numbers, in one pass; one row per column comes to the driver.

    ``columns`` maps a column to its bucket width.
    """
    item = F.array(*[F.struct(F.lit(n).alias("_name"), (c(n) / width).alias("_scaled")) for n, width in columns.items()])
    rows = percentiles(df.select(F.inline(item)), ["_name"], "_scaled", quantiles, width=1.0).collect()
    return {r["_name"]: {q: r[q] * columns[r["_name"]] for q in quantiles} for r in rows}


def full_report(df: DataFrame, *, target: str, pred: str, wind: str = "wind_speed_120m", other_wind: str = "era5v2_wind_speed_120m", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Regime report by wind, source disagreement, three-hour ramp, hour bucket, density and repair count."""
    from galeframe.operators.blocks import diff, run_blocked

    df = run_blocked(df, lambda w: [{"_ramp": F.abs(diff(wind, 3, w))}], back=3)
    df = df.withColumns({"_gap": F.abs(c(wind) - c(other_wind))})
    cuts = fixed_quantiles(df, {"_gap": 0.0625, "_ramp": 0.0625, "air_density": 0.0009765625}, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})
    g, r, d = cuts["_gap"], cuts["_ramp"], cuts["air_density"]
    hour = F.hour(TS)
    rho = c("air_density")
    regimes = {
        "wind": wind_label(wind, REGIME_EDGES),
        "disagreement": quantile_label("_gap", [F.lit(g[k]) for k in ("p50", "p75", "p90")], ["<=p50", "p50-p75", "p75-p90", ">p90"]),
        "ramp": quantile_label("_ramp", [F.lit(r[k]) for k in ("p90", "p95")], ["<=p90", "p90-p95", ">p95"]),
        "hour": F.when(hour < 6, "00-06").when(hour < 12, "06-12").when(hour < 18, "12-18").otherwise("18-24"),
        "density": F.when(rho < d["p25"], "low").when(rho <= d["p75"], "mid").when(rho > d["p75"], "high"),
        "repair": F.when(c("n_repair") >= 3, "3+").otherwise(c("n_repair").cast("string")),
    }
    return regime_report(df, regimes, target=target, pred=pred, cfg=cfg)


def compare_models(df: DataFrame, *, target: str, first: str, second: str, wind: str = "wind_speed_120m", ts: str = TS, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Error and bias of two models overall, by wind bin, hour and month."""
    groups = {"all": F.lit("all"), "wind": wind_label(wind, CURVE_EDGES), "hour": F.hour(ts).cast("string"), "month": F.month(ts).cast("string")}
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.alias("label")) for n, e in groups.items()])
    long = df.select(target, first, second, F.explode(item).alias("_g"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target")]
    for tag, p in (("first", first), ("second", second)):
        aggs += [F.avg(c(p) - c(target)).alias(f"{tag}_bias_mw"), F.avg(F.abs(c(p) - c(target))).alias(f"{tag}_mae_mw"), nmae(target, p, cfg).alias(f"{tag}_nmae_pct")]
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.label").alias("label")).agg(*aggs).filter(c("label").isNotNull())


def implied_wind(df: DataFrame, *, per_turbine_kw: str, rho: str = "air_density", out: str = "implied_ws", halvings: int = 30) -> DataFrame:
    """Wind between 3 and 25 m/s at which the power curve gives ``per_turbine_kw``.

    At a fixed density the curve is linear between whole wind speeds and rises
    up to 14 m/s, so its inverse is a sum of limited segment shares. The result
    is put on the grid that ``halvings`` bisections of the interval end on;
    power above the rising part gives the upper end.
    """
    lo, hi, top = 3, 25, 14
    kw = c(per_turbine_kw)
    df = evaluate_once(df, {f"_k{v}": turbine_power_kw(F.lit(float(v)), rho) for v in range(lo, top + 1)})
    wind = F.lit(0.0)
    for v in range(lo, top):
        share = (kw - c(f"_k{v}")) / (c(f"_k{v + 1}") - c(f"_k{v}"))
        wind = wind + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    cell = (hi - lo) / 2.0 ** halvings
    number = F.greatest(F.lit(0.0), F.ceil(wind / cell).cast("double") - 1.0)
    inside = F.when(kw > c(f"_k{top}"), F.lit(hi - cell / 2.0)).otherwise(lo + (number + 0.5) * cell)
    return evaluate_once(df, {out: F.when(kw.isNotNull() & c(rho).isNotNull(), inside)}).drop(*[f"_k{v}" for v in range(lo, top + 1)])


def implied_wind_bias(df: DataFrame, *, power: str = TARGET, physical: str, wind: str = "wind_speed_120m", active: str = "active_turbines", ts: str = TS,
                      cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Forecast wind minus implied wind, by wind bin and hour, over rows on the sloped part of the curve; ``n`` tells how many."""
    rated = cfg.turbine_rated_mw * 1000.0
    df = df.withColumns({"_kw": F.when(c(active) > 0, c(power) * 1000.0 / c(active))})
    usable = (c(power) > 2.0) & (c("_kw") < rated * 0.95) & (c(power) < c(physical) * 1.3)
    df = implied_wind(df.filter(usable), per_turbine_kw="_kw").withColumns({"_bias": c(wind) - c("implied_ws")})
    groups = {"all": F.lit("all"), "wind": wind_label(wind, CURVE_EDGES), "hour": F.hour(ts).cast("string")}
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.alias("label")) for n, e in groups.items()])
    long = df.select("_bias", wind, "implied_ws", F.explode(item).alias("_g"))
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(wind).alias("mean_wind"), F.avg("implied_ws").alias("mean_implied"), F.avg("_bias").alias("mean_bias")
    ).filter(c("label").isNotNull())


def variance_report(df: DataFrame, series: Mapping[str, Column], *, target: str, wind: str = "wind_speed_120m", base: Mapping[str, Column] | None = None, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """For each series: mean, spread, share of the target's variance it leaves, squared correlation with wind, and the
    error of the forecast that knows only the series' mean (added to ``base`` where given)."""
    names = list(series)
    df = df.withColumns({f"_s{i}": e for i, e in enumerate(series.values())})
    means = df.agg(*[F.avg(f"_s{i}").alias(f"_m{i}") for i in range(len(names))]).first()
    aggs, rows = [F.var_pop(target).alias("_vy")], []
    for i, n in enumerate(names):
        naive = F.lit(means[i]) if base is None or n not in base else base[n] + F.lit(means[i])
        limited = F.greatest(F.lit(0.0), F.least(F.lit(cfg.capacity_mw), naive))
        aggs += [F.avg(f"_s{i}").alias(f"m{i}"), F.stddev_pop(f"_s{i}").alias(f"d{i}"), F.var_pop(f"_s{i}").alias(f"v{i}"), correlation(wind, f"_s{i}").alias(f"r{i}"),
                 (F.avg(F.abs(c(target) - limited)) / cfg.capacity_mw * 100.0).alias(f"e{i}")]
        rows.append(f"'{n}', m{i}, d{i}, v{i}/_vy, r{i}*r{i}, e{i}")
    return df.agg(*aggs).select(F.expr(f"stack({len(names)}, {', '.join(rows)}) AS (series, mean, std, variance_share, r2_wind, naive_nmae_pct)"))


def worst_rows(df: DataFrame, *, target: str, pred: str, n: int, keys: Sequence[str] = (), tie: Sequence[str] = (TS, SITE)) -> DataFrame:
    """The n largest absolute errors overall or per key.

    Per key the row number is limited before the shuffle, so a fold holding most
    rows still sends only n rows per task.
    """
    df = df.withColumns({"abs_error": F.abs(c(target) - c(pred))})
    order = [c("abs_error").desc(), *[c(t) for t in tie]]
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("error_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(c("error_rank") <= n)


# Bins of the residual table.
RESIDUAL_EDGES = (0, 3, 5, 7, 10, 14, 25)


def residual_table(df: DataFrame, *, target: str, pred: str, wind: str = "wind_speed_80m", direction: str = "wind_direction_80m", ts: str = TS) -> DataFrame:
    """Absolute error, bias and root mean square by right-closed wind bin, month and direction sector."""
    err = c(pred) - c(target)
    groups = {"wind": bin_right_closed(wind, RESIDUAL_EDGES), "month": F.month(ts),
              "sector": bin_right_closed(c(direction) * 1000.0, tuple(range(0, 361, 45)), include_lowest=True)}
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.cast("long").alias("bin")) for n, e in groups.items()])
    long = df.select(err.alias("_e"), target, pred, F.explode(item).alias("_g"))
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_true"), F.avg(pred).alias("mean_pred"), F.avg(F.abs("_e")).alias("mean_abs_error"),
        F.avg("_e").alias("bias"), F.sqrt(F.avg(c("_e") * c("_e"))).alias("rmse")).filter(c("bin").isNotNull())


def compare_forecasts(df: DataFrame, *, first: str, second: str, width: float = 0.5) -> DataFrame:
    """Moments, percentiles, largest difference and correlation of two forecasts, one row."""
    gap = c(first) - c(second)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_diff"), F.avg(F.abs(gap)).alias("mean_abs_diff"), F.max(F.abs(gap)).alias("max_abs_diff"),
                  correlation(first, second).alias("correlation"),
                  *[e for tag, p in (("first", first), ("second", second)) for e in (F.avg(p).alias(f"{tag}_mean"), F.stddev_pop(p).alias(f"{tag}_std"), F.min(p).alias(f"{tag}_min"), F.max(p).alias(f"{tag}_max"))])
    both = F.explode(F.array(*[F.struct(F.lit(tag).alias("_which"), c(p).cast("double").alias("_value")) for tag, p in (("first", first), ("second", second))]))
    names = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = percentiles(df.select(both.alias("_b")).select("_b.*"), ["_which"], "_value", names, width=width)
    row = found.agg(*[F.max(F.when(c("_which") == tag, c(n))).alias(f"{tag}_{n}") for tag in ("first", "second") for n in names])
    return sums.withColumn("_one", F.lit(1)).join(row.withColumn("_one", F.lit(1)), "_one").drop("_one")


def compare_forecasts_by(df: DataFrame, *, first: str, second: str, wind: str = "wind_speed_120m", direction: str = "wind_direction_120m") -> DataFrame:
    """Mean of both forecasts and of their difference by wind bin and direction sector."""
    groups = {"wind": bin_left_closed(wind, CURVE_EDGES, clamp=True), "sector": sector_wrapped(c(direction) * 1000.0, 8)}
    item = F.array(*[F.struct(F.lit(n).alias("grouping"), e.cast("long").alias("bin")) for n, e in groups.items()])
    long = df.select(first, second, F.explode(item).alias("_g"))
    return long.groupBy(c("_g.grouping").alias("grouping"), c("_g.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(first).alias("first_mean"), F.avg(second).alias("second_mean"), F.avg(c(first) - c(second)).alias("mean_diff"),
        F.avg(F.abs(c(first) - c(second))).alias("mean_abs_diff"))


def leaderboard(df: DataFrame, models: Mapping[str, str], *, target: str, folds: Sequence[int], fold: str = "fold", cfg: FarmConfig = DEFAULT) -> DataFrame:
    """One row per model: nMAE (by capacity) per fold and overall, from one aggregation."""
    aggs, rows = [], []
    for i, (name, pred) in enumerate(models.items()):
        e = F.abs(c(target) - _limited(pred, cfg))
        aggs += [(F.avg(F.when(c(fold) == f, e)) / cfg.capacity_mw * 100.0).alias(f"m{i}_f{f}") for f in folds]
        aggs.append((F.avg(e) / cfg.capacity_mw * 100.0).alias(f"m{i}_all"))
        rows.append(", ".join([f"'{name}'", *[f"m{i}_f{f}" for f in folds], f"m{i}_all"]))
    cols = ", ".join(["model", *[f"f{f}" for f in folds], "all_folds"])
    return df.agg(*aggs).select(F.expr(f"stack({len(models)}, {', '.join(rows)}) AS ({cols})"))


def regression_gate(df: DataFrame, *, target: str, pred: str, baseline_pct: float, tolerance_pp: float = 0.02, cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Score against a stored baseline; ``passed`` allows the tolerance."""
    out = df.agg(nmae(target, pred, cfg).alias("nmae_pct")).withColumns({"baseline_pct": F.lit(float(baseline_pct))})
    return out.withColumns({"delta_pp": c("nmae_pct") - c("baseline_pct")}).withColumns({"passed": c("delta_pp") <= tolerance_pp})


def curve_fit_report(df: DataFrame, columns: Sequence[str], *, target: str = TARGET) -> DataFrame:
    """Correlation, bias, absolute error and spread of the residual against each theoretical power column."""
    aggs, rows = [], []
    for i, n in enumerate(columns):
        gap = c(target) - c(n)
        aggs += [correlation(target, n).alias(f"r{i}"), F.avg(gap).alias(f"b{i}"), F.avg(F.abs(gap)).alias(f"m{i}"), F.stddev_samp(gap).alias(f"s{i}")]
        rows.append(f"'{n}', r{i}, b{i}, m{i}, s{i}")
    return df.agg(*aggs).select(F.expr(f"stack({len(columns)}, {', '.join(rows)}) AS (curve, correlation, mean_residual, mean_abs_residual, std_residual)"))


# Narrow wind bins near cut-in.
CUTIN_EDGES = (0.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)


def low_wind_table(df: DataFrame, *, wind: str = "v_eff", target: str = TARGET, ts: str = TS, edges: Sequence[float] = CUTIN_EDGES) -> DataFrame:
    """Rows, share of the year, mean, median, quartiles and zero share of power by year and narrow wind bin."""
    tagged = df.select(F.year(ts).alias("year"), c(target), bin_left_closed(wind, edges, clamp=False).alias("ws_bin"))
    counts = tagged.groupBy("year", "ws_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.avg((c(target) < 0.5).cast("int")).alias("zero_share"))
    total = F.sum("n").over(Window.partitionBy("year"))
    sums = counts.withColumns({"share_pct": c("n") * 100.0 / total}).filter(c("ws_bin").isNotNull())
    pct = percentiles(tagged.filter(c("ws_bin").isNotNull()), ["year", "ws_bin"], target, {"median": 0.5, "p25": 0.25, "p75": 0.75}, width=0.05)
    return sums.join(pct, ["year", "ws_bin"], "inner")


def icing_conditions() -> dict[str, Column]:
    t, precip = c("temperature_80m"), c("rain") + c("showers") + c("snowfall")
    return {"below_0": t < 0, "below_2": t < 2, "classic": (t < 0) & (precip > 0), "rime": (t < 2) & (precip > 0),
            "snow": (t < 0) & (c("snowfall") > 0), "heavy_rime": (t < 2) & (precip > 0) & (c("cloud_cover_low") > 80)}


def icing_counts(df: DataFrame, *, ts: str = TS) -> DataFrame:
    """Rows and share of each icing condition by year."""
    conds = icing_conditions()
    wide = df.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(e).alias(n) for n, e in conds.items()])
    rows = ", ".join(f"'{n}', {n}" for n in conds)
    return wide.select("year", "_n", F.expr(f"stack({len(conds)}, {rows}) AS (condition, n)")).select(
        "year", "condition", "n", (c("n") * 100.0 / c("_n")).alias("share_pct"))


def icing_errors(df: DataFrame, *, target: str, pred: str, factors: Sequence[float] = (0.85, 0.90, 0.95), cfg: FarmConfig = DEFAULT) -> DataFrame:
    """Bias and error in each icing condition and outside all of them, and the change a derate would bring."""
    conds = icing_conditions()
    none = None
    for e in conds.values():
        none = e if none is None else none | e
    conds = {**conds, "none": ~none}
    item = F.array_compact(F.array(*[F.when(F.coalesce(e, F.lit(False)), F.lit(n)) for n, e in conds.items()]))
    long = df.select(target, pred, F.explode(item).alias("condition"))
    base = F.avg(F.abs(c(target) - c(pred)))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(c(target) - c(pred)).alias("bias_mw"), (base / cfg.capacity_mw * 100.0).alias("nmae_pct")]
    aggs += [((F.avg(F.abs(c(target) - c(pred) * f)) - base) / cfg.capacity_mw * 100.0).alias(f"delta_{int(round(f * 100))}") for f in factors]
    return long.groupBy("condition").agg(*aggs)
