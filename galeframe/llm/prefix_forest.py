"""Approximate nearest neighbours by largest inner product: a forest of sorted hash strings.

Vectors are scaled by the largest norm and lifted onto the unit sphere by one more coordinate (queries get a zero there), so
the largest inner product is the smallest angle. In each tree a vector has a string of 64 bits: 16 symbols, each the
largest signed coordinate of 8 random projections. A tree is the array of all strings in order, cut into slots: rows that
also hold the vectors. All vectors with a common prefix lie side by side, so a prefix is a range of slots.

A query descends in every tree to its own place, where the slot tells how many entries share each length of prefix
with it; the entries next to these places are compared, and their best ones bound what can be among the nearest. Then all trees ascend together, from the longest common prefix to shorter ones, until the entries passed reach
a number; the entries of these ranges are compared exactly. The number is fitted: for a bounded sample of queries the
true neighbours are found by comparison with every vector, and the smallest number whose recall reaches the target is
taken. At prefix length 0 a single tree holds everything and the search is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from galeframe.llm.common import map_batches, small_batches, stash

SYMBOLS, AXES, BITS = 16, 8, 4
LEVELS = SYMBOLS * BITS
FOUND = "array<struct<rid:bigint,vec_id:bigint,score:double>>"
#: 2 * AXES symbols of BITS bits.
SLOT = "tree int, slot long, first long, last long, n long, keys binary, rids binary, ids binary, vectors binary"


def usable(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, v, h): rows that take part, each with a number of its own and a digest of its vector without trailing zeros."""
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "float" if single else "double"
    v = F.transform(F.col(vector), lambda x: x.cast(kind))
    usual = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(usual & F.exists("v", lambda x: x != 0.0))
    used = F.size("v") - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse("v"), lambda x: x != 0.0), F.lit(True)), F.lit(0)), F.lit(1)).cast("int") + 1
    rows = rows.withColumn("v", F.transform(F.slice("v", F.lit(1), used), lambda x: x + F.lit(0).cast(kind)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "v")), 16, "0") for seed in (1, 2)]).alias("h"))


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as one matrix of doubles; shorter ones go on with zeros."""
    out = np.zeros((len(column), dims))
    lengths = np.diff(np.asarray(column.offsets))
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def lists(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def signed(key: np.ndarray) -> np.ndarray:
    """Strings as long integers of the same order."""
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def unsigned(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key, np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def rotations(dims: int, trees: int, seed: int) -> np.ndarray:
    """(trees, SYMBOLS, dims + 1, AXES) random projections, orthogonal within a symbol where the dimension allows it."""
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(trees, SYMBOLS, dims + 1, AXES))
    return np.linalg.qr(made)[0] if dims + 1 >= AXES else made


def strings(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Hash string of each row in each tree, as unsigned 64-bit numbers (trees, rows); the first symbol has the highest bits."""
    out = np.zeros((len(turns), len(x)), np.uint64)
    for t, tree in enumerate(turns):
        for turn in tree:
            p = x @ turn
            axis = np.abs(p).argmax(1)
            symbol = 2 * axis + (p[np.arange(len(x)), axis] > 0)
            out[t] = (out[t] << np.uint64(BITS)) | symbol.astype(np.uint64)
    return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - np.square(x).sum(1)))[:, None]], 1)


def asked(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x / np.sqrt(np.square(x).sum(1))[:, None], np.zeros((len(x), 1))], 1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, summed in the order of the components, so that equal rows score equally."""
    out = np.zeros(len(x))
    for k in range(len(q)):
        out += q[k] * x[:, k]
    return out


def best(q: np.ndarray, x: np.ndarray, rough: np.ndarray, largest: float, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best rows, ties to smaller ids; ``rough`` are inner products up to rounding, and no
    component of a row is over ``largest``."""
    at = np.arange(len(x))
    if len(x) > k:
        slack = 1e-12 * np.abs(q).sum() * largest
        at = np.flatnonzero(rough >= np.partition(rough, len(x) - k)[len(x) - k] - slack)
    score = inner(q, x[at])
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def prefix_range(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that share ``level`` bits with each key."""
    rest = np.uint64((1 << (LEVELS - level)) - 1)
    return key & ~rest, key | rest


def few_copies(rows: DataFrame, most: int) -> DataFrame:
    """Rows without those that ``most`` equal vectors of smaller id precede: no result can hold them."""
    order = W.Window.partitionBy("h").orderBy("vec_id", "rid")
    ranked = rows.select("h", "vec_id", "rid").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    last = ranked.filter(F.col("_n") == most).select("h", F.col("vec_id").alias("_id"), F.col("rid").alias("_rid"))
    kept = F.col("_id").isNull() | (F.struct("vec_id", "rid") <= F.struct("_id", "_rid"))
    return rows.join(last, "h", "left").filter(kept).drop("_id", "_rid")


def build(rows: DataFrame, *, norm: float, dims: int, turns: np.ndarray, slot_rows: int) -> DataFrame:
    """Slots of all trees: rows of at most ``slot_rows`` neighbouring strings with their vectors."""
    stored = storage(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = dense(batch.column("v"), dims)
            keys, data = strings(lifted(x, norm), turns), binary(x.astype(stored))
            for t in range(len(turns)):
                yield {"tree": np.full(batch.num_rows, t, np.int32), "key": signed(keys[t]), "rid": batch.column("rid"), "vec_id": batch.column("vec_id"), "v": data}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.Table] = []
        count, part, made = 0, None, 0

        def slot(t: pa.Table) -> dict:
            keys = t.column("key").to_numpy()
            return {"tree": [t.column("tree")[0].as_py()], "slot": [(part << 24) + made], "first": [int(keys[0])], "last": [int(keys[-1])], "n": [t.num_rows],
                    "keys": [keys.tobytes()], "rids": [t.column("rid").to_numpy().tobytes()], "ids": [t.column("vec_id").to_numpy().tobytes()],
                    "vectors": [b"".join(t.column("v").to_pylist())]}

        for batch in batches:
            part = batch.column("_part")[0].as_py()
            tree = batch.column("tree").to_numpy()
            ends = [*(np.flatnonzero(np.diff(tree)) + 1).tolist(), batch.num_rows]
            start = 0
            for end in ends:
                while start < end:
                    if held and held[0].column("tree")[0].as_py() != int(tree[start]):
                        yield slot(pa.concat_tables(held))
                        held, count, made = [], 0, made + 1
                    take = min(end - start, slot_rows - count)
                    held.append(pa.Table.from_batches([batch.slice(start, take)]))
                    start, count = start + take, count + take
                    if count == slot_rows:
                        yield slot(pa.concat_tables(held))
                        held, count, made = [], 0, made + 1
        if held:
            yield slot(pa.concat_tables(held))

    entries = map_batches(rows.select("rid", "vec_id", "v"), hashed, "tree int, key long, rid long, vec_id long, v binary")
    entries = entries.repartitionByRange("tree", "key", "rid").sortWithinPartitions("tree", "key", "rid")
    return map_batches(entries.withColumn("_part", F.spark_partition_id().cast("long")), cut, SLOT)


def storage(rows: DataFrame) -> str:
    return "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"


class Heads:
    """First and last string and size of each slot of a tree, in order: 32 bytes for each slot."""

    def __init__(self, tree: np.ndarray, slot: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray):
        self.slot, self.first, self.last, self.n = slot, first, last, n
        self.trees = np.searchsorted(tree, np.arange(int(tree.max(initial=-1)) + 2))

    def span(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the slots that ranges of strings of a tree touch, the end exclusive."""
        a, b = self.trees[tree], self.trees[tree + 1]
        return a + np.searchsorted(self.last[a:b], low, "left"), a + np.searchsorted(self.first[a:b], high, "right")


def joined(slots: DataFrame, slot_rows: int) -> tuple[DataFrame, Heads]:
    """Slots with the neighbours that fit with them under one name, where partitions have left small ones, and their heads."""
    found = slots.select("tree", "slot", "first", "last", "n").toPandas().sort_values(["tree", "slot"])  # one row for each slot
    tree, n = found["tree"].to_numpy(), found["n"].to_numpy(np.int64)
    start, size = np.zeros(len(found), bool), 0
    for i in range(len(found)):
        start[i] = i == 0 or tree[i] != tree[i - 1] or size + n[i] > slot_rows
        size = n[i] if start[i] else size + n[i]
    at = np.flatnonzero(start)
    name = found["slot"].to_numpy(np.int64)[at][np.cumsum(start) - 1]
    first, last = (unsigned(found[c].to_numpy()) for c in ("first", "last"))
    heads = Heads(tree[at], name[at], first[at], last[np.append(at[1:], len(found)) - 1], np.add.reduceat(n, at))
    if len(at) < len(found):
        names = slots.sparkSession.createDataFrame(pd.DataFrame({"slot": found["slot"].to_numpy(np.int64), "_name": name}))
        slots = slots.join(names, "slot").withColumnRenamed("slot", "at").withColumnRenamed("_name", "slot")
    else:
        slots = slots.withColumn("at", F.col("slot"))
    return slots, heads


def opened(found: pd.DataFrame, dims: int, stored: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings, row numbers, ids and vectors of a slot."""
    found = found.sort_values("at")
    keys, rids, ids = (np.frombuffer(b"".join(found[c]), np.int64) for c in ("keys", "rids", "ids"))
    return unsigned(keys), rids, ids, np.frombuffer(b"".join(found["vectors"]), stored).reshape(len(keys), dims).astype(float)


def meet(asked_rows: DataFrame, slots: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most: int) -> DataFrame:
    """Rows with their slot; a slot that more than ``most`` rows ask for is copied, and the rows are dealt over the copies."""
    heavy = asked_rows.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_of")).filter("_of > 1")
    of = F.coalesce("_of", F.lit(1))
    left = asked_rows.join(heavy, "slot", "left").withColumn("_copy", F.pmod(F.xxhash64("h"), of).cast("int")).drop("_of")
    right = slots.join(heavy, "slot", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), of - 1))).drop("_of")
    return left.groupBy("slot", "_copy").cogroup(right.groupBy("slot", "_copy")).applyInPandas(fn, schema)


def descend(slots: DataFrame, queries: DataFrame, heads: Heads, *, dims: int, turns: np.ndarray, k: int, most: int, stored: str, around: int = 256) -> DataFrame:
    """(h, passed, bound, found): for every prefix length, how many entries of all trees share it with the query; and the ``k``
    best of the entries next to its own places, with the last one's score where there are as many.

    A query goes to its own slot of each tree. Entries there are counted exactly; other slots of the range count whole.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = dense(batch.column("v"), dims)
            keys = strings(asked(x), turns)
            for t in range(len(turns)):
                own, _ = heads.span(t, keys[t], keys[t])
                yield {"h": batch.column("h"), "slot": heads.slot[np.minimum(own, heads.trees[t + 1] - 1)], "tree": np.full(batch.num_rows, t, np.int32), "key": signed(keys[t]), "q": binary(x)}

    def count(places: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if places.empty or found.empty:
            return pd.DataFrame({"h": [], "passed": [], "found": []}, dtype=object)
        tree, mine = int(places["tree"].iloc[0]), int(np.searchsorted(heads.slot, places["slot"].iloc[0]))
        keys, rids, ids, x = opened(found, dims, stored)
        total = np.concatenate([[0], np.cumsum(heads.n)])
        key = unsigned(places["key"].to_numpy())
        passed = np.zeros((len(key), LEVELS + 1), np.int64)
        for level in range(LEVELS + 1):
            low, high = prefix_range(key, level)
            a, b = heads.span(tree, low, high)
            inside = np.searchsorted(keys, high, "right") - np.searchsorted(keys, low, "left")
            passed[:, level] = inside + total[np.maximum(a, b)] - total[a] - np.where((a <= mine) & (mine < b), heads.n[mine], 0)
        q, largest, near = np.frombuffer(b"".join(places["q"])).reshape(len(key), dims), np.abs(x).max(), []
        for i, at in enumerate(np.searchsorted(keys, key)):
            some = slice(max(0, at - around), at + around)
            rows, score = best(q[i], x[some], x[some] @ q[i], largest, ids[some], k)
            near.append([{"rid": r, "vec_id": v, "score": f} for r, v, f in zip(rids[some][rows].tolist(), ids[some][rows].tolist(), score.tolist())])
        return pd.DataFrame({"h": places["h"], "passed": passed.tolist(), "found": near})

    places = map_batches(queries.select("h", "v"), place, "h string, slot long, tree int, key long, q binary")
    counted = meet(places, slots.select("slot", "at", "keys", "rids", "ids", "vectors"), count, f"h string, passed array<long>, found {FOUND}", most)
    sums = [F.sum(F.col("passed")[i]).alias(f"_{i}") for i in range(LEVELS + 1)]
    told = counted.groupBy("h").agg(*sums, F.flatten(F.collect_list("found")).alias("_all"))  # a list from each tree
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(
        a["vec_id"] != b["vec_id"], F.when(a["vec_id"] < b["vec_id"], -1).otherwise(1)).when(a["rid"] < b["rid"], -1).when(a["rid"] > b["rid"], 1).otherwise(0)
    top = F.slice(F.array_sort(F.array_distinct("_all"), order), 1, k)
    told = told.select("h", F.array(*[f"_{i}" for i in range(LEVELS + 1)]).alias("passed"), top.alias("found"))
    return told.withColumn("bound", F.get(F.col("found")["score"], k - 1))


def true_neighbours(rows: DataFrame, sample: list, *, dims: int, k: int) -> DataFrame:
    """(h, v): the ``k`` best vectors of each sampled query, by comparison with every vector."""
    names, q = [r["h"] for r in sample], dense(lists([r["v"] for r in sample]), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept = [(np.zeros((0, dims)), np.zeros(0, np.int64), np.zeros(0))] * len(names)
        for batch in batches:
            x, rid = dense(batch.column("v"), dims), batch.column("rid").to_numpy()
            rough, largest = q @ x.T, np.abs(x).max(initial=0.0)
            for i in range(len(names)):
                at, score = best(q[i], x, rough[i], largest, rid, k)
                vectors, rids, scores = (np.concatenate(p) for p in zip(kept[i], (x[at], rid[at], score)))
                order = np.lexsort((rids, -scores))[:k]
                kept[i] = vectors[order], rids[order], scores[order]
        for name, (vectors, rids, scores) in zip(names, kept):
            yield {"h": [name] * len(rids), "rid": rids, "score": scores, "v": list(vectors)}
    met = map_batches(rows.select("rid", "v"), run, "h string, rid long, score double, v array<double>")
    order = W.Window.partitionBy("h").orderBy(F.col("score").desc(), "rid")
    return met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("h", "v")


def common_prefixes(sample: list, neighbours: list, *, dims: int, norm: float, turns: np.ndarray) -> dict[str, np.ndarray]:
    """For each sampled query, the bits its true neighbours share with it in the tree where they come closest."""
    if not sample:
        return {}
    at = {h: i for i, (h, _) in enumerate(sample)}
    whose = np.array([at[r["h"]] for r in neighbours])
    own = strings(asked(dense(lists([v for _, v in sample]), dims)), turns)[:, whose]
    differ = own ^ strings(lifted(dense(lists([r["v"] for r in neighbours]), dims), norm), turns)
    bits = np.where(differ == 0, LEVELS, LEVELS - 1 - np.floor(np.log2(np.maximum(differ, np.uint64(1)).astype(np.longdouble))).astype(np.int64)).max(0)
    return {h: bits[whose == i] for h, i in at.items()}


def fit_budget(counts: dict[str, np.ndarray], shared: dict[str, np.ndarray], recall: float) -> int:
    """The smallest number of passed entries at which the sample reaches ``recall``; ``shared`` are the prefix lengths that
    true neighbours have in common with their query in the tree where they come closest."""
    if not shared:
        return 1
    levels = np.arange(LEVELS + 1)
    passed = np.stack([counts[h] for h in shared])
    found = np.stack([(shared[h][:, None] >= levels).mean(0) for h in shared])
    tried = np.unique(passed)
    low, high = 0, len(tried) - 1
    while low < high:
        mid = (low + high) // 2
        at = LEVELS - (passed >= tried[mid])[:, ::-1].argmax(1)  # the longest prefix with enough entries
        at[~(passed >= tried[mid]).any(1)] = 0
        if found[np.arange(len(at)), at].mean() >= recall:
            high = mid
        else:
            low = mid + 1
    return int(tried[low])


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, trees: int = 8, slot_rows: int = 16_384, visit_rows: int = 16_384, recall: float = 0.95, sample: int = 256, seed: int = 7,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id is divisible by ``every``.

    Null vectors, zero vectors and vectors with null or non-finite components take no part, nor do rows without an id. A
    shorter vector goes on with zeros. Rows stand for themselves: a row is no candidate of its own, while other rows with
    its id are, and repeated query rows each have a result. Ties go to the smaller id. An empty table gives no rows.
    Other columns are not read. ``sample`` queries, those whose vector digests are smallest, fit the number of entries.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stash(usable(vectors, vec_id=vec_id, vector=vector))
    told = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).first()
    if told["dims"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, norm = int(told["dims"]), float(np.sqrt(told["square"]))
    stored = storage(rows)
    turns = rotations(dims, trees, seed)
    slots, heads = joined(stash(build(few_copies(rows, k + 1), norm=norm, dims=dims, turns=turns, slot_rows=slot_rows)), slot_rows)
    asking = rows.filter(F.col("vec_id") % every == 0)
    queries = stash(asking.groupBy("h").agg(F.min_by("v", "rid").alias("v")))
    counts = stash(descend(slots, queries, heads, dims=dims, turns=turns, k=k + 1, most=visit_rows, stored=stored))

    tried = queries.orderBy("h").limit(sample).collect()
    shared = common_prefixes([(r["h"], r["v"]) for r in tried], true_neighbours(rows, tried, dims=dims, k=k + 1).collect(), dims=dims, norm=norm, turns=turns)
    known = {r["h"]: np.array(r["passed"]) for r in counts.select("h", "passed").filter(F.col("h").isin(list(shared))).collect()} if shared else {}
    enough = fit_budget(known, shared, recall)
    longest = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: F.get("passed", i) >= enough))
    level = counts.select("h", "bound", F.coalesce(longest, F.lit(0)).alias("level"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = dense(batch.column("v"), dims)
            keys, data, levels = strings(asked(x), turns), binary(x), batch.column("level").to_numpy()
            for at in np.unique(levels):
                some = np.flatnonzero(levels == at)
                for t in range(len(turns) if at else 1):  # without a prefix one tree holds everything
                    low, high = prefix_range(keys[t][some], int(at))
                    a, b = heads.span(t, low, high)
                    goes = np.repeat(np.arange(len(some)), np.maximum(b - a, 0))
                    step = np.arange(len(goes)) - np.repeat(np.cumsum(np.maximum(b - a, 0)) - np.maximum(b - a, 0), np.maximum(b - a, 0))
                    rows_at = pa.array(some[goes])
                    yield {"h": batch.column("h").take(rows_at), "bound": batch.column("bound").take(rows_at), "q": data.take(rows_at), "slot": heads.slot[a[goes] + step],
                           "low": signed(low[goes]), "high": signed(high[goes])}

    def search(visits: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"h": [], "rid": [], "vec_id": [], "score": []}
        if len(visits) and len(found):
            keys, rids, ids, x = opened(found, dims, stored)
            largest = np.abs(x).max()
            low, high = (unsigned(visits[c].to_numpy()) for c in ("low", "high"))
            a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            q, bound = np.frombuffer(b"".join(visits["q"])).reshape(len(visits), dims), visits["bound"].fillna(-np.inf).to_numpy(float)
            names = visits["h"].to_numpy()
            for start, end in {(int(i), int(j)) for i, j in zip(a, b) if j > i}:
                part, same = x[start:end], np.flatnonzero((a == start) & (b == end))
                for some in np.array_split(same, -(-len(same) // 256)):
                    for i, rough in zip(some, q[some] @ part.T):
                        at, score = best(q[i], part, rough, largest, ids[start:end], k + 1)
                        at, score = at[score >= bound[i]], score[score >= bound[i]]
                        out["h"].append(np.repeat(names[i], len(at)))
                        out["rid"].append(rids[start:end][at])
                        out["vec_id"].append(ids[start:end][at])
                        out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, object if c == "h" else np.float64 if c == "score" else np.int64) for c, v in out.items()})

    visits = stash(map_batches(queries.join(level, "h"), route, "h string, bound double, q binary, slot long, low long, high long"))
    met = meet(visits, slots.select("slot", "at", "keys", "rids", "ids", "vectors"), search, "h string, rid long, vec_id long, score double", visit_rows)
    met = met.unionByName(counts.select("h", F.inline("found")))
    order = W.Window.partitionBy("h").orderBy(F.col("score").desc(), "vec_id", "rid")
    top = met.dropDuplicates(["h", "rid"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    mine = asking.select("h", F.col("vec_id").alias("query_id"), F.col("rid").alias("_own"))
    own = W.Window.partitionBy("_own").orderBy(F.col("score").desc(), "vec_id", "rid")
    ranked = mine.join(top, "h").filter(F.col("_own") != F.col("rid")).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
