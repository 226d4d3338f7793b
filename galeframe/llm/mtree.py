"""Exact top-k by inner product with a paged M-tree.

Scaled vectors are lifted onto a sphere of radius M (the largest norm) by one more coordinate, sqrt(M^2 - |x|^2), and
queries get a zero there: the largest inner products are then the smallest Euclidean distances, and the lifted space is
a metric one. The tree has three levels. A bounded sample gives the routing objects below the root. Under a routing
object, vectors sorted by their distance to it fill pages of bounded size, each with its nearest and farthest distance.
In a page, leaf nodes have a routing object, a covering radius, the distance to their parent, and the distance of every
entry to its leaf. Pages are rows of a table.

Blocks of queries meet slots of pages. A block visits its pages best first, from a bound that the sample gives. Pages,
leaves and entries fall to |d(q, parent) - d(parent, node)| - radius, from stored distances alone, before any distance
to them is computed. What is left is computed exactly, on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from galeframe.llm.common import map_batches, small_batches, stash

PAGE = "pivot int, slot_key long, near double, far double, ids binary, vectors binary, leaf_of binary, leaf_vectors binary, leaf_parent binary, leaf_radius binary, entry_parent binary"


def scaled(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector, as doubles that hold integers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine"))
    return rows.filter("fine").select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)).cast("double")).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 53 bits by Python integers, held within 64."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return np.rint(q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def build_page(pivot: int, key: int, ids: np.ndarray, x: np.ndarray, parent: np.ndarray, most: float, leaf_rows: int) -> dict:
    """One paged node; ``x`` sorted by ``parent``, the distance to the page's routing object."""
    up = lift(x, most)
    route = np.unique(np.linspace(0, len(x) - 1, -(-len(x) // leaf_rows)).round().astype(int))
    to_leaf = distances(up, up[route])
    leaf = to_leaf.argmin(1)
    own = to_leaf[np.arange(len(x)), leaf]
    radius = np.zeros(len(route))
    np.maximum.at(radius, leaf, own)
    return {"pivot": pivot, "slot_key": key, "near": float(parent[0]), "far": float(parent[-1]), "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(),
            "leaf_of": leaf.astype("<i4").tobytes(), "leaf_vectors": x[route].astype("<f8").tobytes(), "leaf_parent": parent[route].astype("<f8").tobytes(),
            "leaf_radius": radius.astype("<f8").tobytes(), "entry_parent": own.astype("<f8").tobytes()}


def build_tree(vectors: DataFrame, pivots: np.ndarray, most: float, *, page_rows: int = 1024, leaf_rows: int = 32, stream_pages: int = 4) -> DataFrame:
    """Pages of (vec_id, v). Rows of one routing object are dealt to sorted streams of about ``stream_pages`` pages each,
    so a routing object with many rows, or copies of one vector, neither meet in one task nor in one page."""
    spark, dim = vectors.sparkSession, pivots.shape[1]
    routes = spark.sparkContext.broadcast(pivots)  # a bounded sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        up = lift(routes.value, most)
        for batch in batches:
            if batch.num_rows:
                d = distances(lift(_matrix(batch.column("v"), dim), most), up)
                yield {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "pivot": d.argmin(1).astype(np.int32), "parent": d.min(1)}

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: tuple = (None, None, [], [], [])

        def cut(last: bool) -> Iterator[dict]:
            nonlocal held
            pivot, salt, ids, x, parent = held
            if pivot is None:
                return
            ids, x, parent = (np.concatenate(c) for c in (ids, x, parent))
            whole = len(ids) if last else len(ids) // page_rows * page_rows
            for s in range(0, whole, page_rows):
                t = slice(s, min(s + page_rows, whole))
                yield build_page(pivot, int(ids[s]), ids[t], x[t], parent[t], most, leaf_rows)
            held = (pivot, salt, [ids[whole:]], [x[whole:]], [parent[whole:]]) if whole < len(ids) else (None, None, [], [], [])

        for batch in batches:
            pivot, salt = batch.column("pivot").to_numpy(), batch.column("salt").to_numpy()
            ids, x, parent = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim), batch.column("parent").to_numpy()
            edges = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(salt) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(ids)]):
                if e == s:
                    continue
                found = []
                if (held[0], held[1]) != (pivot[s], salt[s]):
                    found += cut(True)
                    held = (int(pivot[s]), int(salt[s]), [], [], [])
                for column, part in zip(held[2:], (ids, x, parent)):
                    column.append(part[s:e])
                found += cut(False)
                if found:
                    yield {k: [r[k] for r in found] for k in found[0]}
        found = list(cut(True))
        if found:
            yield {k: [r[k] for r in found] for k in found[0]}

    near = stash(map_batches(vectors, assign, "vec_id long, v array<double>, pivot int, parent double"))
    streams = near.groupBy("pivot").agg(F.ceil(F.count("*") / (stream_pages * page_rows)).cast("int").alias("streams"))  # a row per routing object
    near = near.join(F.broadcast(streams), "pivot").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("streams")).cast("int"))
    return map_batches(near.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "parent", "vec_id"), pages, PAGE)


class Best:
    """The k best of each query so far, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def put(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (rows x candidates) with the least integer where a candidate does not count."""
        least = np.iinfo(np.int64).min
        useful = (score >= self.score[rows, -1:]) & (score > least)
        hit = useful.any(1)
        rows, score, useful = rows[hit], score[hit], useful[hit]
        if not len(rows):
            return
        columns = useful.any(0)
        score, ids = np.where(useful, score, least)[:, columns], ids[columns]
        s = np.hstack([self.score[rows], score])
        i = np.hstack([self.id[rows], np.where(score > least, ids[None], np.iinfo(np.int64).max)])
        order = np.lexsort((i, -np.maximum(s, least + 1)), axis=1)[:, :self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_block(query_ids: np.ndarray, q: np.ndarray, pages: list[dict], pivots: np.ndarray, floor: np.ndarray, most: float, k: int) -> Best:
    """Best-first search of the pages; ``floor`` is a score that at least k candidates of a query reach."""
    best = Best(len(q), k)
    norm = (q * q).sum(1)
    to_pivot = distances(np.hstack([q, np.zeros((len(q), 1))]), lift(pivots, most))
    slack = 1e-6 * np.sqrt(most + norm) + 1e-6

    def reach() -> np.ndarray:
        s = np.maximum(floor, best.score[:, -1].astype(np.float64))
        return np.where(s > -9e18, np.sqrt(np.maximum(norm + most - 2 * s, 0)) + slack, np.inf)

    gap = np.stack([np.maximum(np.maximum(to_pivot[:, p["pivot"]] - p["far"], p["near"] - to_pivot[:, p["pivot"]]), 0) for p in pages], 1)
    lifted = np.hstack([q, np.zeros((len(q), 1))])
    for n in np.argsort(gap.min(0), kind="stable"):
        page, bound = pages[n], reach()
        rows = np.flatnonzero(gap[:, n] <= bound)
        if not len(rows):
            continue
        dim, parent = q.shape[1], to_pivot[rows, page["pivot"], None]
        read = {c: np.frombuffer(page[c], t) for c, t in (("ids", "<i8"), ("vectors", "<f8"), ("leaf_of", "<i4"), ("leaf_vectors", "<f8"), ("leaf_parent", "<f8"), ("leaf_radius", "<f8"), ("entry_parent", "<f8"))}
        x, routes = read["vectors"].reshape(-1, dim), read["leaf_vectors"].reshape(-1, dim)
        edge = bound[rows, None]
        near = np.abs(parent - read["leaf_parent"]) - read["leaf_radius"] <= edge
        leaves = np.flatnonzero(near.any(0))
        if not len(leaves):
            continue
        to_leaf = np.full(near.shape, np.inf)
        to_leaf[:, leaves] = distances(lifted[rows], lift(routes[leaves], most))
        near &= to_leaf - read["leaf_radius"] <= edge
        kept = near.any(1)
        rows, near, to_leaf, edge = rows[kept], near[kept], to_leaf[kept], edge[kept]
        entries = np.flatnonzero(near.any(0)[read["leaf_of"]])
        if not len(rows) or not len(entries):
            continue
        leaf = read["leaf_of"][entries]
        with np.errstate(invalid="ignore"):
            wanted = near[:, leaf] & (np.abs(to_leaf[:, leaf] - read["entry_parent"][entries]) <= edge)
        columns = wanted.any(0)
        entries, wanted = entries[columns], wanted[:, columns]
        ids = read["ids"][entries]
        score = inner(q[rows], x[entries])
        score[~wanted | (ids[None] == query_ids[rows, None])] = np.iinfo(np.int64).min
        best.put(rows, score, ids)
    return best


def top_k(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          pivots: int = 256, page_rows: int = 1024, block_rows: int = 2048, slot_pages: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products with rows of another id, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``, or those of ``queries``. Rows without an id, vectors that
    are missing or hold missing or non-finite components, and vectors of another length than most take no part. Equal
    query rows are asked once; candidate rows that repeat count each. Other columns are not read. At most ``pivots``
    rows are sampled, to route; all rows are indexed and all pages that could matter are read.
    """
    spark = vectors.sparkSession
    rows = stash(scaled(vectors, vec_id=vec_id, vector=vector, scale=scale))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if lengths is None or lengths["n"] == 0:
        return empty
    dim = lengths["n"]
    rows = rows.filter(F.size("v") == dim)
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else scaled(queries, vec_id=vec_id, vector=vector, scale=scale).filter(F.size("v") == dim)
    asked = asked.dropDuplicates(["vec_id", "v"])
    n_asked, most = asked.count(), rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if not n_asked:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    sample_ids, sample_x = np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample], float).reshape(-1, dim)
    route = np.unique(sample_x[:max(1, -(-lengths["rows"] // page_rows))], axis=0)  # about as many as pages, at most the sample
    pages = stash(build_tree(rows, route, most, page_rows=page_rows))
    blocks, slots = -(-n_asked // block_rows), -(-pages.count() // slot_pages)
    held = spark.sparkContext.broadcast((sample_ids, sample_x, route))

    small_batches(spark)

    def search(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, known, routes = held.value
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "question": [], "vec_id": [], "score": []}).astype("int64")
        query_ids, q = left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(float)
        floor = np.where(ids[None] == query_ids[:, None], -np.inf, (q @ known.T))
        floor = np.sort(floor, 1)[:, -k] if floor.shape[1] >= k else np.full(len(q), -np.inf)
        best = search_block(query_ids, q, right.to_dict("records"), routes, np.floor(floor - 1 - np.abs(floor) * 1e-9), most, k)
        at, place = np.nonzero(best.id != np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": query_ids[at], "question": left["question"].to_numpy()[at], "vec_id": best.id[at, place], "score": best.score[at, place]})

    asked = asked.withColumn("question", F.xxhash64("vec_id", "v")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    left = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).groupBy("block", "slot")
    right = (pages.withColumn("slot", F.pmod(F.xxhash64("pivot", "slot_key"), F.lit(slots)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "slot"))
    found = left.cogroup(right).applyInPandas(search, "query_id long, question long, vec_id long, score long")
    order = W.Window.partitionBy("query_id", "question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
