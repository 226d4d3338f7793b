"""Flags for impossible, curtailed and mislabelled rows, and training weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import DEFAULT, REPAIR, RHO_STD, SITE, TARGET, TS, FarmConfig
from galeframe.functions.curve import farm_power_mw
from galeframe.functions.nullsafe import clip, div, evaluate_once, flag, has, zero_if_null
from galeframe.operators.joins import KEY, join_with_coverage, last_by_key
from galeframe.operators.lookups import apply_site_curve, fit_site_curve, valid_target
from galeframe.operators.ranks import percentiles, values_at_ranks
from galeframe.operators.settle import settle
from galeframe.operators.windows import keep_long_runs

c = F.col

# Reason codes in order of priority.
REASONS = ("over_capacity", "maintenance_zero", "rated_plateau_shortfall", "low_wind_high_power")


class CleanerSanityError(ValueError):
    pass


def impossible_rules(df: DataFrame, cfg: FarmConfig = DEFAULT) -> dict[str, Column]:
    """The four impossible-row rules as boolean columns; anything unknown is False, a missing column an error."""
    target, ws120, gust = c(TARGET), c("wind_speed_120m"), c("wind_gusts_10m")
    active = cfg.total_turbines - F.coalesce(c(REPAIR), F.lit(0))
    ws_max = F.greatest("wind_speed_10m", "wind_speed_80m", "wind_speed_120m")
    calm = (
        ((ws_max < 4.0) & (gust < 6.0) & (target > 20.0))
        | ((ws120 < 3.0) & (gust < 5.0) & (target > 15.0))
        | ((ws120 < 4.0) & (gust < 7.0) & (target > 30.0))
    )
    rules = {
        "over_capacity": target > cfg.capacity_mw,
        "maintenance_zero": (active <= 2) & (target < 1.0),
        "rated_plateau_shortfall": (ws120 > 14.0) & (active >= 24) & (target < 60.0),
        "low_wind_high_power": calm,
    }
    return {n: F.coalesce(rules[n], F.lit(False)) for n in REASONS}


def impossible_rule_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"rule_{n}": e.cast("int") for n, e in impossible_rules(df).items()})


def impossible_reasons(df: DataFrame, *, out: str = "impossible_reason") -> DataFrame:
    """Reason code of the first rule that holds, or empty text, and the flag."""
    reason = F.lit("")
    for name, cond in reversed(impossible_rules(df).items()):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    df = df.withColumns({out: reason})
    return df.withColumns({"_is_impossible": c(out) != ""})


def rule_guard(df: DataFrame, *, limit: float = 0.05) -> DataFrame:
    """One row: rows, rows per rule, flagged share, allowed share and verdict. Whoever checks few rows passes a higher limit."""
    rules = impossible_rules(df)
    any_rule = None
    for e in rules.values():
        any_rule = e if any_rule is None else any_rule | e
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_rule).alias("n_flagged"),
                 *[F.count_if(e).alias(f"n_{n}") for n, e in rules.items()])
    allowed = F.lit(float(limit))
    share = zero_if_null(div("n_flagged", "n_rows"))
    return out.withColumns({"flagged_share": share, "allowed_share": allowed, "within_limit": share <= allowed})


def require_sane_rules(df: DataFrame, *, limit: float = 0.05) -> DataFrame:
    """Fail when the rules flag too large a share of the table."""
    g = rule_guard(df, limit=limit).first()
    if not g["within_limit"]:
        counts = ", ".join(f"{n}={g[f'n_{n}']}" for n in REASONS)
        raise CleanerSanityError(f"rules flag {g['flagged_share']:.3%} of {g['n_rows']} rows: {counts}")
    return df


def training_weights(df: DataFrame, *, year: int = 2022, year_factor: float = 1.0) -> DataFrame:
    """0 for impossible rows, ``year_factor`` for rows of one year, else 1."""
    df = impossible_reasons(df)
    weight = F.when(c("_is_impossible"), F.lit(0.0)).when(F.year(TS) == year, F.lit(float(year_factor))).otherwise(F.lit(1.0))
    return df.withColumns({"weight": weight})


def imputation_flag(df: DataFrame, before: str, after: str, *, out: str) -> DataFrame:
    """True where the value was missing before and is present after."""
    for n in (before, after):
        if n not in df.columns:
            raise KeyError(n)
    return df.withColumns({out: c(before).isNull() & c(after).isNotNull()})


def imputation_flag_between(before: DataFrame, after: DataFrame, *, value: str = "wind_speed_180m", keys: Sequence[str] = KEY) -> DataFrame:
    """The same flag for two versions of a table, aligned by key."""
    name = "ws_180m_is_imputed" if value == "wind_speed_180m" else f"{value}_is_imputed"
    old = before.select(*keys, c(value).alias("_before"))
    return imputation_flag(after.join(old, list(keys), "left"), "_before", value, out=name).drop("_before")


def disagreement_flag(df: DataFrame, *, first: str = "wind_speed_120m", second: str = "era5_wind_speed_100m", threshold: float = 5.0,
                      out: str = "nwp_era5_disagreement") -> DataFrame:
    """Flags large source differences; rows are kept. A missing source gives False."""
    if not has(df, first, second):
        return df.withColumns({out: F.lit(0)})
    return df.withColumns({out: flag(F.abs(c(first) - c(second)) > threshold)})


@dataclass(frozen=True)
class CurtailmentConfig:
    min_wind_ms: float = 5.0
    fraction: float = 0.4
    min_expected_mw: float = 15.0
    min_run_rows: int = 3
    curve: str = "isotonic"


def curtailment_columns(df: DataFrame, cfg: CurtailmentConfig = CurtailmentConfig(), *, wind: str = "wind_speed_120m",
                        impossible: str | None = "_is_impossible", farm: FarmConfig = DEFAULT) -> DataFrame:
    """Expected power, ratio, and the flag before and after the run-length rule."""
    df = df.withColumns({"ws": zero_if_null(wind), "target": zero_if_null(TARGET)})
    if cfg.curve == "isotonic":
        usable = valid_target()
        if impossible and impossible in df.columns:
            usable = usable & ~F.coalesce(c(impossible).cast("boolean"), F.lit(False))
        df = apply_site_curve(df, fit_site_curve(df, wind="ws", target=TARGET, fit_filter=usable), wind="ws", out="expected")
    elif cfg.curve == "datasheet":
        active = F.greatest(F.lit(0), farm.total_turbines - F.coalesce(c(REPAIR), F.lit(0)))
        rho = zero_if_null("air_density", RHO_STD) if "air_density" in df.columns else F.lit(RHO_STD)
        df = evaluate_once(df, {"expected": farm_power_mw("ws", rho, active, farm)})
    else:
        raise ValueError(f"unknown curve {cfg.curve!r}")
    df = df.withColumns({"ratio": F.when(c("expected") > cfg.min_expected_mw, div("target", "expected"))})
    pre = (c("ws") >= cfg.min_wind_ms) & (c("expected") >= cfg.min_expected_mw) & (c("ratio") < cfg.fraction)
    df = df.withColumns({"flagged_pre_run": flag(pre)})
    if cfg.min_run_rows <= 1:
        return df.withColumns({"flagged": c("flagged_pre_run") == 1})
    return keep_long_runs(df, flag_col="flagged_pre_run", min_rows=cfg.min_run_rows)


def curtailment_summary(diag: DataFrame) -> DataFrame:
    hit = c("flagged").cast("boolean")
    out = diag.agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum("flagged_pre_run").alias("pre_run_flagged"), F.count_if(hit).alias("post_run_flagged"),
        F.coalesce(F.avg(F.when(hit, c("target"))), F.lit(0.0)).alias("mean_target_on_flagged"),
        F.coalesce(F.avg(F.when(hit, c("expected"))), F.lit(0.0)).alias("mean_expected_on_flagged"))
    return out.withColumns({"pct_flagged": zero_if_null(div(c("post_run_flagged") * 100.0, "total_rows"))})


def trimmed_spread(df: DataFrame, keys: Sequence[str], value: str, *, trim: float = 0.05, width: float = 0.5) -> DataFrame:
    """Population deviation of each group's middle rows; NULL for groups that must never flag.

    The cut positions come from exact ranks and the middle is summed with
    partial aggregation, so no group is ever sorted in one task.
    """
    keys = list(keys)
    cut = F.floor(F.lit(trim) * c("_n"))
    bounds = values_at_ranks(df, keys, value, {"_v_lo": cut, "_v_hi": c("_n") - cut - 1}, width=width)
    bounds = settle(bounds.withColumns({"_cut": cut, "_mid": (c("_v_lo") + c("_v_hi")) / 2.0}))
    v = c(value) - c("_mid")
    inside = (c(value) > c("_v_lo")) & (c(value) < c("_v_hi"))
    sums = df.filter(c(value).isNotNull()).join(bounds, keys, "inner").groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in ("_n", "_cut", "_v_lo", "_v_hi", "_mid")],
        F.count_if(c(value) <= c("_v_lo")).alias("_le_lo"), F.count_if(c(value) < c("_v_hi")).alias("_lt_hi"),
        F.coalesce(F.sum(F.when(inside, v)), F.lit(0.0)).alias("_s1"), F.coalesce(F.sum(F.when(inside, v * v)), F.lit(0.0)).alias("_s2"))
    keep_lo, keep_hi = c("_le_lo") - c("_cut"), c("_n") - c("_cut") - c("_lt_hi")
    d_lo, d_hi = c("_v_lo") - c("_mid"), c("_v_hi") - c("_mid")
    size = (c("_n") - 2 * c("_cut")).cast("double")
    s1 = c("_s1") + keep_lo * d_lo + keep_hi * d_hi
    s2 = c("_s2") + keep_lo * d_lo * d_lo + keep_hi * d_hi * d_hi
    variance = s2 / size - (s1 / size) * (s1 / size)
    never = (c("_n") < 3) | (size <= 1) | (c("_v_lo") == c("_v_hi"))
    spread = F.when(~never & (variance > 0), F.sqrt(variance))
    return sums.select(*keys, c("_n").alias("n"), spread.alias("sigma"))


def residual_flags(df: DataFrame, oof: DataFrame, *, k: float = 3.0, bin_width: float = 1.0, min_coverage: float | None = 0.5) -> DataFrame:
    """Rows whose residual exceeds k trimmed deviations of their wind bin; unmatched rows are not flagged.

    ``oof`` holds (site, hour, y_oof); repeated hours must carry ``version`` to choose the last.
    """
    slim = last_by_key(oof, order="version") if "version" in oof.columns else oof
    slim = slim.select(*KEY, "y_oof")
    joined = df.join(slim, KEY, "left") if min_coverage is None else join_with_coverage(df, slim, at_least=min_coverage)
    ws_bin = F.least(F.lit(30), F.greatest(F.lit(0), F.floor(c("wind_speed_120m") / bin_width).cast("int")))
    joined = joined.withColumns({"residual": c(TARGET) - c("y_oof"), "ws_bin": ws_bin})
    sigma = trimmed_spread(joined.filter(c("residual").isNotNull()).select(SITE, "ws_bin", "residual"), [SITE, "ws_bin"], "residual")
    limits = settle(sigma.select(SITE, "ws_bin", (k * c("sigma")).alias("threshold")))
    out = joined.join(limits, [SITE, "ws_bin"], "left")
    return out.withColumns({"residual_flag": flag(F.abs("residual") > c("threshold"))})


def residual_guard(flagged: DataFrame, *, limit: float = 0.02) -> DataFrame:
    """Flagged share of the matched rows against the allowed share."""
    out = flagged.agg(F.count("residual").alias("n_matched"), F.sum("residual_flag").alias("n_flagged"))
    share = zero_if_null(div("n_flagged", "n_matched"))
    return out.withColumns({"flagged_share": share, "within_limit": share <= limit})


def month_weights(df: DataFrame, *, ts: str = TS, scheme: str = "march", summer: float = 0.5, deep_winter: float = 1.0,
                  out: str = "month_weight") -> DataFrame:
    """Month factors: March only, March with January and February, or summer against deep winter."""
    m = F.month(ts)
    one = F.lit(1.0)
    schemes = {
        "march": F.when(m == 3, F.lit(3.0)).otherwise(one),
        "winter": F.when(m == 3, F.lit(3.0)).when(m <= 2, F.lit(2.0)).otherwise(one),
        "winter_soft": F.when(m == 3, F.lit(3.0)).when(m <= 2, F.lit(1.5)).otherwise(one),
        "season": F.when(m.between(4, 9), F.lit(float(summer))).when(m.isin(12, 1, 2), F.lit(float(deep_winter))).otherwise(one),
    }
    return df.withColumns({out: schemes[scheme]})


# Weight by calendar year, and for later years.
YEAR_WEIGHTS = {2022: 1.0, 2023: 1.5, 2024: 2.0, 2025: 3.0}
LATER_YEAR_WEIGHT = 6.0


def decay_weights(df: DataFrame, *, train_end, lam: float, ts: str = TS, keys: Sequence[str] = ()) -> DataFrame:
    """exp(-lam * age / largest age), age in hours before ``train_end``; 1 when all ages are under an hour."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(train_end).cast("timestamp")) - F.unix_timestamp(c(ts).cast("timestamp"))) / 3600.0)
    df = df.withColumns({"_age": age})
    value = F.when(c("_max_age") < 1.0, F.lit(1.0)).otherwise(F.exp(-lam * div("_age", "_max_age")))
    if keys:
        widest = settle(df.groupBy(*keys).agg(F.max("_age").alias("_max_age")))
        return df.join(widest, list(keys), "left").withColumns({"time_weight": value}).drop("_age", "_max_age")
    return df.withColumn("_max_age", df.agg(F.max("_age")).scalar()).withColumns({"time_weight": value}).drop("_age", "_max_age")


def half_life_weights(df: DataFrame, *, reference, days: float = 180.0, ts: str = TS) -> DataFrame:
    age = (F.unix_timestamp(F.lit(reference).cast("timestamp")) - F.unix_timestamp(c(ts).cast("timestamp"))) / 86_400.0
    return df.withColumns({"recency_weight": F.exp(age * (-math.log(2.0) / days))})


def year_weights(df: DataFrame, *, ts: str = TS) -> DataFrame:
    out = F.lit(LATER_YEAR_WEIGHT)
    for y, w in YEAR_WEIGHTS.items():
        out = F.when(F.year(ts) == y, F.lit(w)).otherwise(out)
    return df.withColumns({"year_weight": out})


# Overlapping wind bands of the specialists.
BANDS = {"low_0_7": (0.0, 7.0), "mid_4_12": (4.0, 12.0), "high_8_25": (8.0, 25.0)}


def band_weights(df: DataFrame, *, wind: str = "wind_speed_120m", inside: float = 2.0, outside: float = 0.3, base: str | None = None) -> DataFrame:
    """One weight column per wind band."""
    factor = F.lit(1.0) if base is None else c(base)
    return df.withColumns({
        f"weight_{n}": F.when((c(wind) >= lo) & (c(wind) < hi), F.lit(inside)).otherwise(F.lit(outside)) * factor
        for n, (lo, hi) in BANDS.items()})


def similarity_weights(df: DataFrame, *, prob: str, scale: float = 100.0, floor: float = 0.5, ceiling: float = 4.0) -> DataFrame:
    """Weights from the probability of looking like the scoring period: log-scaled by its 95th
    percentile, and square-root and quarter-power forms scaled to mean 1; all per site."""
    raw = F.log1p(clip(prob, 0.0) * scale)
    df = df.withColumns({"_raw": raw, "_soft": F.sqrt(c(prob) + 0.01), "_pow4": F.pow(c(prob) + 0.005, F.lit(0.25))})
    p95 = percentiles(df, [SITE], "_raw", {"_p95": 0.95}, width=0.05)
    means = df.groupBy(SITE).agg(F.avg("_soft").alias("_soft_mean"), F.avg("_pow4").alias("_pow4_mean"))
    out = df.join(settle(p95.join(means, SITE, "full")), SITE, "left")
    scaled = floor + div("_raw", "_p95") * (ceiling - floor)
    return out.withColumns({"_scaled": scaled, "_s": div("_soft", "_soft_mean"), "_q": div("_pow4", "_pow4_mean")}).withColumns({
        "adv_weight": F.when(c("_p95") <= 0, F.lit(1.0)).otherwise(clip("_scaled", floor, ceiling)),
        "av_soft_weight": clip("_s", 0.05, 10.0), "av_pow4_weight": clip("_q", 0.05, 10.0),
    }).drop("_raw", "_soft", "_pow4", "_p95", "_soft_mean", "_pow4_mean", "_scaled", "_s", "_q")
