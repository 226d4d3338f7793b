"""Exact order statistics of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here
a group is first counted into value buckets of a fixed width (partial
aggregation, small result). Prefix sums over the buckets tell which bucket
holds each wanted rank; that short list is settled and only the rows of those
buckets are shuffled and looked at value by value.
The result equals linear interpolation between order statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.operators.settle import settle

_ALL = "_all"


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], *, width: float | Column
) -> DataFrame:
    """One row per key with the value at each zero-based rank, and the group size ``_n``.

    ``ranks`` maps output names to integer expressions of ``_n``; ``width`` is
    the bucket width in units of ``value`` (any positive number is correct, a
    good one leaves a few rows per bucket); a column gives each row its own,
    the same for all rows of a key.
    """
    keys = list(keys)
    width = width if isinstance(width, Column) else F.lit(float(width))
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.floor(F.col(value) / width).alias("_b")
    )
    w_all = Window.partitionBy(*keys)
    w_run = w_all.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .withColumns({"_end": F.sum("_c").over(w_run), "_n": F.sum("_c").over(w_all)})
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    wanted = F.array(*[e.cast("long") for e in ranks.values()])
    hits = settle(
        hist.withColumn("_wanted", wanted)
        .withColumn("_here", F.filter("_wanted", lambda r: (r >= F.col("_start")) & (r < F.col("_end"))))
        .filter(F.size("_here") > 0)
        .select(*keys, "_b", "_start", "_n", "_wanted")
        .withColumnsRenamed({k: f"{k}__h" for k in [*keys, "_b"]})
    )
    near = rows.join(hits, _on([*keys, "_b"]), "inner").drop(*[f"{k}__h" for k in [*keys, "_b"]])
    cand = near.groupBy(*keys, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(n).alias(n) for n in ("_start", "_n", "_wanted")])
    w_in = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cand.withColumn("_hi", F.col("_start") + F.sum("_c").over(w_in)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = [
        F.max(F.when((F.get("_wanted", F.lit(i)) >= F.col("_lo")) & (F.get("_wanted", F.lit(i)) < F.col("_hi")), F.col("_v"))).alias(name)
        for i, name in enumerate(ranks)
    ]
    return placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)


def _on(keys: Sequence[str]) -> Column:
    cond = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}__h"))
    for k in keys[1:]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__h"))
    return cond


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], *, width: float | Column, count: str | None = None
) -> DataFrame:
    """Exact interpolated percentiles per key; one row per key that has a value."""
    whole = not keys
    if whole:
        df, keys = df.withColumn(_ALL, F.lit(1)), [_ALL]
    ranks: dict[str, Column] = {}
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        ranks[f"_lo_{name}"] = F.floor(place)
        ranks[f"_hi_{name}"] = F.ceil(place)
    picked = values_at_ranks(df, keys, value, ranks, width=width)
    out = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place).cast("double"))).alias(name))
    if count:
        out.append(F.col("_n").alias(count))
    return picked.select(*([] if whole else keys), *out)


def table_medians(df: DataFrame, widths: Mapping[str, float]) -> dict[str, Column]:
    """Exact medians of whole columns, as literals; ``widths`` gives each column its bucket width.

    However many columns, ``df`` is read twice: once for the bucket counts, once for the values next to the medians.
    """
    item = F.array(*[F.struct(F.lit(n).alias("_name"), F.col(n).cast("double").alias("_value"), F.lit(float(w)).alias("_width"))
                     for n, w in widths.items()])
    stacked = df.select(F.inline(item))
    found = percentiles(stacked, ["_name"], "_value", {"median": 0.5}, width=F.col("_width")).collect()
    medians = {r["_name"]: r["median"] for r in found}
    return {n: F.lit(medians.get(n)).cast("double") for n in widths}
