"""Sharding by bytes: the minimax contiguous partition of ordered cells of equal texts. Built-in expressions only.

Atomic groups are cells: a text's xxhash64 picks one of ``cells`` cells, so equal texts always share one. The sizes of
all cells are a digest of fixed length. The smallest capacity for which a greedy walk over the ordered cells needs no
more than the given shards is found by bisection, and the walk's cuts at that capacity are the shards. A cell as large
as an even share of what is left (a large group of copies) gets a shard of its own first, so the others stay equal.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from galeframe.llm.common import stash

OVERHEAD = 16


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """First indexes of the shards that a greedy walk makes under ``capacity``."""
    cuts, load = [0], 0
    for i, s in enumerate(sizes):
        if load and load + s > capacity:
            cuts.append(i)
            load = 0
        load += s
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the contiguous partition into at most ``shards`` parts whose largest part is smallest."""
    low, high = max([-(-sum(sizes) // shards), *sizes, 0]), max(sum(sizes), 0)
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return greedy_cuts(sizes, low)


def assign_cells(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of each cell: oversized cells alone, the others cut contiguously in cell order."""
    rest, out, nxt = dict(sizes), {}, 0
    total = sum(rest.values())
    for cell, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if shards - nxt <= 1 or size * (shards - nxt) < total:
            break
        out[cell], nxt, total = nxt, nxt + 1, total - size
        del rest[cell]
    order = sorted(rest)
    cuts = set(minimax_cuts([rest[c] for c in order], shards - nxt))
    for i, cell in enumerate(order):
        nxt += i > 0 and i in cuts
        out[cell] = nxt
    return out


def shard_documents(docs: DataFrame, *, shards: int = 40, cells: int = 1 << 14, slice_rows: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    A missing text has no bytes and the checksum 0. Rows that repeat an id get slots of their own; a missing id is
    placed like any other. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stash(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                             F.pmod(F.xxhash64(body), F.lit(cells)).cast("int").alias("cell"))
                 .withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)).cast("int")))
    found = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most ``cells`` rows
    shard_of = assign_cells({r["cell"]: r["bytes"] for r in found}, shards)
    count = {r["cell"]: r["n"] for r in found}
    order = sorted(count, key=lambda c: (shard_of[c], c))
    starts = dict(zip(order, [0, *accumulate(count[c] for c in order)]))
    first = {}
    for c in order:
        first.setdefault(shard_of[c], starts[c])
    plan = spark.createDataFrame([(c, shard_of[c], starts[c] - first[shard_of[c]], -(-count[c] // slice_rows)) for c in order], "cell int, shard int, cell_start long, n_slices int")
    placed = rows.join(F.broadcast(plan), "cell").withColumn("slice", F.pmod(F.col("_part"), F.col("n_slices")))
    # a slice holds about slice_rows rows, however large its cell
    slice_start = W.Window.partitionBy("cell").orderBy("slice").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = placed.groupBy("cell", "slice").agg(F.count("*").alias("n")).select("cell", "slice", F.coalesce(F.sum("n").over(slice_start), F.lit(0)).alias("slice_start"))
    within = F.row_number().over(W.Window.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("_n", within).join(offsets, ["cell", "slice"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("cell_start") + F.col("slice_start") + F.col("_n") - 1).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
