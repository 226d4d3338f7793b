"""Rolling, difference, lead and lag columns per site.

Frames count rows. Each operator runs through ``run_blocked``, so a single long
site is spread over many tasks; chained operators can share one numbering by
passing a table that already has the row column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.config import PRESSURE, SITE, TARGET, TS
from galeframe.functions.nullsafe import clip, correlation, div, flag, join_null_safe, unit_dot, zero_if_null
from galeframe.operators.settle import settle
from galeframe.operators.blocks import diff, epoch, lag, lead, roll_mean, roll_std, run_blocked, with_row_number

c = F.col


def rolling_columns(df: DataFrame, value: str, *, prefix: str, rows: Sequence[int] = (3, 6, 12, 24),
                    min_rows: int = 1) -> DataFrame:
    """Rolling mean and sample deviation; a deviation of one row is 0."""
    def build(w):
        return [{
            **{f"{prefix}_roll_mean_{n}h": roll_mean(value, n, w, min_rows) for n in rows},
            **{f"{prefix}_roll_std_{n}h": zero_if_null(roll_std(value, n, w, min_rows)) for n in rows},
        }]
    return run_blocked(df, build, back=max(rows) - 1)


def rolling_columns_by_time(df: DataFrame, value: str, *, prefix: str, hours: Sequence[int] = (3, 6, 12, 24),
                            bucket_hours: int = 720) -> DataFrame:
    """The same statistics over the last n hours instead of the last n rows.

    Rows within reach of a later time bucket are copied into it, so a long site
    still spreads over its buckets.
    """
    reach, size = max(hours) * 3600, bucket_hours * 3600
    e = epoch()
    copies = F.sequence(F.floor(e / size), F.floor((e + reach) / size))
    spread = df.withColumns({"_e": e}).withColumn("_bucket", F.explode(copies))
    w = Window.partitionBy(SITE, "_bucket").orderBy("_e")
    out = {}
    for h in hours:
        frame = w.rangeBetween(-(h * 3600 - 1), 0)
        out[f"{prefix}_roll_mean_{h}h"] = F.avg(value).over(frame)
        out[f"{prefix}_roll_std_{h}h"] = zero_if_null(F.stddev_samp(value).over(frame))
    return spread.withColumns(out).filter(c("_bucket") == F.floor(c("_e") / size)).drop("_e", "_bucket")


def difference_columns(df: DataFrame, spec: dict[str, tuple[str, int]]) -> DataFrame:
    """``spec`` maps an output name to (column, rows back); missing history gives 0."""
    def build(w):
        return [{name: zero_if_null(diff(value, n, w)) for name, (value, n) in spec.items()}]
    return run_blocked(df, build, back=max(n for _, n in spec.values()))


def gustiness_columns(df: DataFrame, value: str, dir_sin: str, dir_cos: str, *, prefix: str) -> DataFrame:
    """Six-row turbulence intensity and one-row change of the direction components."""
    def build(w):
        return [{
            f"{prefix}_turb_intensity_6h": zero_if_null(roll_std(value, 6, w)) / (roll_mean(value, 6, w) + 1e-3),
            f"{prefix}_dir_sin_diff1": zero_if_null(diff(dir_sin, 1, w)),
            f"{prefix}_dir_cos_diff1": zero_if_null(diff(dir_cos, 1, w)),
        }]
    return run_blocked(df, build, back=5)


def source_rolling_set(df: DataFrame, *, wind: str, pressure: str, dir_sin: str, dir_cos: str, wind_prefix: str,
                       prefix: str, rows: Sequence[int] = (3, 6, 12, 24)) -> DataFrame:
    """The full rolling set of one weather source in a single pass over the blocks."""
    def build(w):
        return [{
            **{f"{wind_prefix}_roll_mean_{n}h": roll_mean(wind, n, w) for n in rows},
            **{f"{wind_prefix}_roll_std_{n}h": zero_if_null(roll_std(wind, n, w)) for n in rows},
            **{f"{wind_prefix}_diff{n}": zero_if_null(diff(wind, n, w)) for n in (1, 3, 6)},
            **{f"{prefix}_pressure_diff{n}": zero_if_null(diff(pressure, n, w)) for n in (3, 6, 12)},
            f"{prefix}_turb_intensity_6h": zero_if_null(roll_std(wind, 6, w)) / (roll_mean(wind, 6, w) + 1e-3),
            f"{prefix}_dir_sin_diff1": zero_if_null(diff(dir_sin, 1, w)),
            f"{prefix}_dir_cos_diff1": zero_if_null(diff(dir_cos, 1, w)),
        }]
    return run_blocked(df, build, back=max(12, max(rows) - 1))


def ramp_columns(df: DataFrame, *, wind: str = "wind_speed_120m", cutin: float = 2.0, bandwidth: float = 1.0) -> DataFrame:
    """Three- and six-row wind change, cut-in flags and their products."""
    def build(w):
        return [{f"dv_{n}h": zero_if_null(diff(wind, n, w)) for n in (3, 6)}]
    df = run_blocked(df, build, back=6)
    soft = clip((cutin + bandwidth - c(wind)) / bandwidth, 0.0, 1.0)
    out = {"is_sub_cutin": flag(c(wind) < cutin), "is_sub_cutin_soft": soft}
    for n in (3, 6):
        out |= {f"dv_{n}h_x_sub_cutin": c(f"dv_{n}h") * soft, f"abs_dv_{n}h": F.abs(f"dv_{n}h")}
    return df.withColumns(out)


def lead_columns(df: DataFrame, *, wind: str = "wind_speed_120m", leads: Sequence[int] = (3, 6, 12, 24),
                 ramps: Sequence[int] = (6, 12)) -> DataFrame:
    """Forecast wind ahead, its ramp and the pressure change; 0 past the end."""
    def build(w):
        out = {f"struct_nwp_lead{n}h": zero_if_null(lead(wind, n, w)) for n in leads}
        out |= {f"struct_nwp_ramp_{n}h": zero_if_null(lead(wind, n, w) - c(wind)) for n in ramps}
        if PRESSURE in df.columns:
            out |= {f"struct_dp_future_{n}h": zero_if_null(lead(PRESSURE, n, w) - c(PRESSURE)) for n in (6, 12)}
        return [out]
    return run_blocked(df, build, ahead=max(*leads, *ramps, 12))


def extended_rolling_columns(df: DataFrame) -> DataFrame:
    """Rolling statistics of further sources with half-window minimum, and second differences."""
    def build(w):
        out: dict[str, Column] = {}
        if "gfs_ws100m" in df.columns:
            for n in (6, 12, 24):
                out[f"gfs_ws100_roll{n}h_mean"] = roll_mean("gfs_ws100m", n, w, n // 2)
                out[f"gfs_ws100_roll{n}h_std"] = zero_if_null(roll_std("gfs_ws100m", n, w, n // 2))
            out["gfs_ws100_accel"] = diff("gfs_ws100m", 1, w) - diff("gfs_ws100m", 2, w)
        if "ecmwf_ws100m" in df.columns:
            for n in (6, 12):
                out[f"ecmwf_ws100_roll{n}h_mean"] = roll_mean("ecmwf_ws100m", n, w, n // 2)
            out["ecmwf_ws100_accel"] = diff("ecmwf_ws100m", 1, w) - diff("ecmwf_ws100m", 2, w)
        if "ens3_ws100_std" in df.columns:
            for n in (6, 12):
                out[f"ens3_spread_roll{n}h_mean"] = roll_mean("ens3_ws100_std", n, w)
        return [out] if out else []
    return run_blocked(df, build, back=23)


def direction_change_columns(df: DataFrame, *, dir_sin: str = "wind_dir_120m_sin", dir_cos: str = "wind_dir_120m_cos") -> DataFrame:
    """Turning over one and three rows and the six-row deviation of the one-row turning."""
    def build(w):
        s1, c1 = F.coalesce(lag(dir_sin, 1, w), c(dir_sin)), F.coalesce(lag(dir_cos, 1, w), c(dir_cos))
        first = {
            "dir_change_1h": F.acos(unit_dot(dir_sin, dir_cos, s1, c1)),
            "dir_change_3h_sin": c(dir_sin) - F.coalesce(lag(dir_sin, 3, w), c(dir_sin)),
            "dir_change_3h_cos": c(dir_cos) - F.coalesce(lag(dir_cos, 3, w), c(dir_cos)),
        }
        second = {
            "dir_change_3h_mag": F.sqrt(c("dir_change_3h_sin") * c("dir_change_3h_sin")
                                        + c("dir_change_3h_cos") * c("dir_change_3h_cos")),
            "dir_stability_6h": zero_if_null(roll_std("dir_change_1h", 6, w)),
        }
        return [first, second]
    return run_blocked(df, build, back=6)


def direction_instability_columns(df: DataFrame, *, prefix: str = "gfs", rows: Sequence[int] = (12, 24)) -> DataFrame:
    """One minus the mean resultant length, and the angle between two sources."""
    s, k = f"{prefix}_dir100m_sin", f"{prefix}_dir100m_cos"

    def build(w):
        out = {}
        for n in rows:
            ms, mc = roll_mean(s, n, w, n // 2), roll_mean(k, n, w, n // 2)
            out[f"{prefix}_dir_instability_{n}h"] = 1.0 - clip(F.sqrt(ms * ms + mc * mc), 0.0, 1.0)
        return [out]
    df = run_blocked(df, build, back=max(rows) - 1)
    if {"ecmwf_dir100m_sin", "ecmwf_dir100m_cos"} <= set(df.columns):
        df = df.withColumns({"gfs_ecmwf_dir_diff": F.acos(unit_dot(s, k, "ecmwf_dir100m_sin", "ecmwf_dir100m_cos"))})
    return df


def trend_columns(df: DataFrame, values: dict[str, str], *, rows: Sequence[int] = (6, 12)) -> DataFrame:
    """``values`` maps a column to the prefix of its trend columns; missing history stays NULL."""
    def build(w):
        return [{f"{prefix}_trend_{n}h": diff(v, n, w) for v, prefix in values.items() for n in rows}]
    return run_blocked(df, build, back=max(rows))


def power_lag_columns(df: DataFrame, *, power: str = TARGET, lags: Sequence[int] = (1, 3, 6, 12, 24), fill: float = 0.0) -> DataFrame:
    """Lagged power, rolling statistics of the past and two ramps."""
    def past(w, n):
        return w.rowsBetween(-n, -1)

    def build(w):
        out = {f"lag_power_{n}h": zero_if_null(lag(power, n, w), fill) for n in lags}
        for n in (6, 12, 24):
            enough = F.count(power).over(past(w, n)) >= n // 2
            out[f"power_roll{n}h_mean"] = zero_if_null(F.when(enough, F.avg(power).over(past(w, n))), fill)
            if n < 24:
                out[f"power_roll{n}h_std"] = zero_if_null(F.when(enough, F.stddev_samp(power).over(past(w, n))), fill)
        out["power_ramp_1h"] = zero_if_null(lag(power, 1, w) - lag(power, 2, w))
        out["power_ramp_3h"] = zero_if_null(lag(power, 1, w) - lag(power, 4, w))
        return [out]
    return run_blocked(df, build, back=max(24, *lags))


def short_lag_columns(df: DataFrame, *, power: str = TARGET) -> DataFrame:
    """Short lags and lagged three- and six-row means; missing history stays NULL."""
    def build(w):
        out = {f"power_lag{n}h": lag(power, n, w) for n in (1, 2, 3, 6)}
        for n in (3, 6):
            out[f"power_rmean{n}h"] = F.avg(power).over(w.rowsBetween(-n, -1))
        return [out]
    return run_blocked(df, build, back=6)


def walk_forward_rate(df: DataFrame, *, value: str, chunk_seconds: int = 60 * 86_400) -> DataFrame:
    """Mean and count of ``value`` over strictly earlier rows of the same (month, hour).

    The history is unbounded, so it is summed in two steps: totals of earlier
    time chunks from a small prefix sum, then a running sum inside the chunk.
    """
    keys = [SITE, "_month", "_hour"]
    tagged = df.withColumns({
        "_month": F.month(TS), "_hour": F.hour(TS), "_chunk": F.floor(epoch() / chunk_seconds),
        "_x": zero_if_null(value), "_k": c(value).isNotNull().cast("long"),
    })
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_sx"), F.sum("_k").alias("_sk")).select(
        *keys, "_chunk", zero_if_null(F.sum("_sx").over(earlier)).alias("_px"),
        F.coalesce(F.sum("_sk").over(earlier), F.lit(0)).alias("_pk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(TS).rowsBetween(Window.unboundedPreceding, -1)
    run = tagged.withColumns({
        "_rx": zero_if_null(F.sum("_x").over(inside)), "_rk": F.coalesce(F.sum("_k").over(inside), F.lit(0)),
    })
    run = join_null_safe(run, totals, [*keys, "_chunk"])
    count = c("_pk") + c("_rk")
    return run.withColumns({
        "avail_underprod_rate_mh": zero_if_null(div(c("_px") + c("_rx"), count)),
        "avail_underprod_count_mh": count,
    }).drop("_month", "_hour", "_chunk", "_x", "_k", "_px", "_pk", "_rx", "_rk")


def trailing_days_mean(df: DataFrame, *, value: str, out: str = "avail_underprod_rate_30d", days: int = 30) -> DataFrame:
    """Mean over [t - days, t); each row also visits the next time bucket, so buckets are independent."""
    span = days * 86_400
    e = epoch()
    copies = F.sequence(F.floor(e / span), F.floor((e + span) / span))
    spread = df.withColumns({"_e": e}).withColumn("_bucket", F.explode(copies))
    w = Window.partitionBy(SITE, "_bucket").orderBy("_e").rangeBetween(-span, -1)
    return (spread.withColumns({out: zero_if_null(F.avg(value).over(w))})
            .filter(c("_bucket") == F.floor(c("_e") / span)).drop("_e", "_bucket"))


def keep_long_runs(df: DataFrame, *, flag_col: str, out: str = "flagged", min_rows: int = 3) -> DataFrame:
    """Keep a flag only inside runs of at least ``min_rows`` flagged rows.

    A row is kept when some window of ``min_rows`` consecutive rows around it is
    all flagged, which needs a bounded frame instead of whole runs.
    """
    n = min_rows - 1

    def build(w):
        back_full = (F.min(F.coalesce(c(flag_col).cast("int"), F.lit(0))).over(w.rowsBetween(-n, 0)) == 1) & (
            F.count(F.lit(1)).over(w.rowsBetween(-n, 0)) == min_rows)
        return [{"_ends": back_full.cast("int")}, {out: F.max("_ends").over(w.rowsBetween(0, n)) == 1}]
    return run_blocked(df, build, back=n, ahead=n).drop("_ends")


def run_lengths(df: DataFrame, *, flag_col: str) -> DataFrame:
    """One row per run of flagged rows with its start, end and length.

    Position among all rows minus position among flagged rows is constant
    inside a run, and both positions come from the distributed numbering.
    """
    numbered = with_row_number(df, name="_pos").filter(c(flag_col).cast("boolean"))
    islands = with_row_number(numbered, name="_hit").withColumn("_run", c("_pos") - c("_hit"))
    return islands.groupBy(SITE, "_run").agg(
        F.min(TS).alias("run_start"), F.max(TS).alias("run_end"), F.count(F.lit(1)).alias("run_rows")).drop("_run")


def run_statistics(df: DataFrame, *, flag_col: str) -> DataFrame:
    return run_lengths(df, flag_col=flag_col).groupBy(SITE).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("run_rows").alias("mean_run_rows"), F.max("run_rows").alias("max_run_rows"))


def skill_weights(df: DataFrame, *, target: str = TARGET, expected: str, rows: int = 720, min_rows: int = 24,
                  eps: float = 1.0) -> DataFrame:
    """Weight 1 / (rolling absolute error + eps), scaled to mean 1 per site."""
    df = df.withColumns({"_abs": F.abs(c(target) - c(expected))})

    def build(w):
        return [{"_roll": roll_mean("_abs", rows, w, min_rows)}]
    rolled = run_blocked(df, build, back=rows - 1)
    site_mean = settle(df.groupBy(SITE).agg(F.avg("_abs").alias("_site_abs")))
    raw = rolled.join(site_mean, SITE, "left").withColumns(
        {"_skill": 1.0 / (F.coalesce(c("_roll"), c("_site_abs")) + eps)})
    scale = settle(raw.groupBy(SITE).agg(F.avg("_skill").alias("_mean_skill")))
    return raw.join(scale, SITE, "left").withColumns({"skill_weight": div("_skill", "_mean_skill")}).drop(
        "_abs", "_roll", "_site_abs", "_skill", "_mean_skill")


def lag_autocorrelation(df: DataFrame, *, value: str = TARGET, lags: Sequence[int] = (1, 2, 3, 6, 12, 24)) -> DataFrame:
    """Correlation of a series with itself n rows back; one row per site and lag."""
    def build(w):
        return [{f"_lag{n}": lag(value, n, w) for n in lags}]
    lagged = run_blocked(df.select(SITE, TS, value), build, back=max(lags))
    wide = lagged.groupBy(SITE).agg(*[correlation(value, f"_lag{n}").alias(f"_c{n}") for n in lags])
    pairs = ", ".join(f"{n}, _c{n}" for n in lags)
    return wide.select(SITE, F.expr(f"stack({len(lags)}, {pairs}) AS (lag, autocorrelation)"))


def lookback_sequences(df: DataFrame, *, features: Sequence[str], target: str = TARGET, rows: int = 12) -> DataFrame:
    """The ``rows`` rows before each row as an array, oldest first; rows without full history are dropped."""
    def build(w):
        item = F.struct(*[c(f).alias(f) for f in features])
        return [{"sequence": F.collect_list(item).over(w.rowsBetween(-rows, -1))}]
    seq = run_blocked(df.select(SITE, TS, target, *[f for f in features if f != target]), build, back=rows)
    return seq.filter(F.size("sequence") == rows).select(SITE, TS, target, "sequence")


def day_sequences(df: DataFrame, *, features: Sequence[str], target: str = TARGET, rows_per_day: int = 24) -> DataFrame:
    """Whole days as ordered arrays: exactly ``rows_per_day`` rows and no missing target.

    A group is one site-day, so the collected list is bounded.
    """
    item = F.struct(c(TS), *[c(f) for f in dict.fromkeys([*features, target])])
    days = df.groupBy(SITE, F.to_date(TS).alias("day")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(target).alias("_k"), F.sort_array(F.collect_list(item)).alias("sequence"))
    return days.filter((c("_n") == rows_per_day) & (c("_k") == rows_per_day)).drop("_n", "_k")


def tiered_power(df: DataFrame, *, oof: DataFrame, scored: DataFrame, split: str = "_split", target: str = TARGET,
                 out: str = "power_series") -> DataFrame:
    """Power history for lags: scored rows take the earlier test prediction, training rows the
    out-of-fold prediction where there is one, and otherwise the measured power."""
    key = [SITE, TS]
    o = oof.select(*key, c("pred_cf_mw").alias("_oof"))
    s = scored.select(*key, c("pred_mw").alias("_scored"))
    joined = df.join(o, key, "left").join(s, key, "left")
    return joined.withColumns({
        out: F.when(c(split) == "valid", c("_scored")).otherwise(F.coalesce(c("_oof"), c(target)))
    }).drop("_oof", "_scored")


