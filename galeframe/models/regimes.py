"""Clusters of standardised columns: parallel seeding by rounds of hash-drawn rows, then means until they are at rest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.config import SITE, TS
from galeframe.operators.settle import settle

c = F.col
POINT = "_z"


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with one array of the columns, each less its mean and over its deviation; a missing value lies at the mean."""
    x = [c(n).cast("double") for n in columns]
    row = df.agg(*[e for i, v in enumerate(x) for e in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]).first()
    return df.withColumn(POINT, F.array(*[F.coalesce((v - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(row[f"s{i}"] or 1.0)), F.lit(0.0)) for i, v in enumerate(x)]))


def distances(centres: np.ndarray) -> Column:
    """Squared distances of a point to all centres."""
    out = []
    for centre in centres:
        total = F.lit(0.0)
        for i, v in enumerate(centre):
            away = F.get(POINT, i) - F.lit(float(v))
            total = total + away * away
        out.append(total)
    return F.array(*out)


def nearest(centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equally near ones."""
    d = distances(centres)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def drawn(rows: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """Seeds: in each round a row is drawn with a chance in proportion to its distance from the seeds so far, 2k rows at a time on
    average. The draw is a hash of site, time and round, so a repeated run draws the same rows."""
    def uniform(turn: int) -> Column:
        return F.pmod(F.xxhash64(SITE, TS, F.lit(seed), F.lit(turn)), F.lit(1 << 40)).cast("double") / float(1 << 40)

    first = rows.orderBy(F.xxhash64(SITE, TS, F.lit(seed)), SITE, TS).select(POINT).limit(1).collect()
    seeds = np.array([r[0] for r in first])
    for turn in range(rounds):
        far = rows.withColumn("_d", F.array_min(distances(seeds)))
        total = far.agg(F.sum("_d")).first()[0]
        if not total:
            break
        new = far.filter(uniform(turn) < c("_d") * (2.0 * k / total)).select(POINT).collect()  # about 2k rows
        seeds = np.unique(np.concatenate([seeds, *([[r[0] for r in new]] if new else [])]), axis=0)
    return seeds


def reduced(seeds: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the weighted seeds: each the one that takes most of the distance left, then means of the seeds."""
    chosen = [int(weight.argmax())]
    d = np.square(seeds[:, None] - seeds[None]).sum(2)
    while len(chosen) < min(k, len(seeds)):
        left = d[:, chosen].min(1)
        saved = (weight[:, None] * np.maximum(left[:, None] - d, 0.0)).sum(0)
        saved[chosen] = -1.0
        chosen.append(int(saved.argmax()))
    centres = seeds[chosen]
    for _ in range(50):
        own = np.square(seeds[:, None] - centres[None]).sum(2).argmin(1)
        new = np.array([np.average(seeds[own == j], axis=0, weights=weight[own == j]) if weight[own == j].sum() > 0 else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres


def cluster(df: DataFrame, *, columns: Sequence[str], k: int = 5, seed: int = 42, rounds: int = 4, most: int = 200, tolerance: float = 1e-3, out: str = "regime_cluster") -> tuple[DataFrame, np.ndarray]:
    """Rows with the number of their cluster, and the centres in standardised columns, in order of their first column.

    Every row is with its nearest centre. Passes end when no centre moves by more than ``tolerance`` deviations, so every centre
    is the mean of its rows up to about that; they also end after ``most`` passes. There are fewer clusters than ``k`` where there are fewer distinct rows.
    """
    rows = standardised(df, columns)
    points = settle(rows.select(SITE, TS, POINT))
    seeds = drawn(points, k, rounds, seed)
    if not len(seeds):
        return rows.drop(POINT).withColumn(out, F.lit(None).cast("int")), seeds
    held = {r["j"]: r["n"] for r in points.groupBy(nearest(seeds).alias("j")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = reduced(seeds, np.array([held.get(j, 0) for j in range(len(seeds))], float), k)
    for _ in range(most):
        sums = points.groupBy(nearest(centres).alias("j")).agg(*[F.avg(F.get(POINT, i)).alias(f"m{i}") for i in range(len(columns))]).collect()
        new = centres.copy()
        for r in sums:
            new[r["j"]] = [r[f"m{i}"] for i in range(len(columns))]
        moved, centres = np.abs(new - centres).max(), new
        if moved <= tolerance:
            break
    centres = centres[np.lexsort(centres.T[::-1])]
    return rows.withColumn(out, nearest(centres)).drop(POINT), centres
