"""Connected components of a link table by alternating stars; every round is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, stash


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Links of one batch, replaced by one link from each node to the smallest node it reaches inside the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for end in (a, b, root[a], root[b]):
                np.minimum.at(new, end, low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        own = root != np.arange(len(nodes))
        yield {"u": nodes[own], "v": nodes[root[own]]}


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v of type long) that is not its component's smallest."""
    links = stash(map_batches(links.select("u", "v"), _forest, "u long, v long").distinct())
    state = _state(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        links = stash(small)
        now = _state(links)
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")
