"""Many boosted-tree models grown side by side.

A model is a column of row weights (0: the row takes no part) and a column that says where it is judged, so bands, seeds,
folds or hours of day are models over the same rows. Rows are binned once, by edges from a mergeable quantile sketch, and
lie in written blocks of small integers. A level of all trees of all models is one pass: tasks add up gradients by (model,
node, feature, bin), and the sums of a model meet in one group that picks its splits, so only splits reach the driver. The
number of passes does not depend on the number of models. A model's part of a block is the rows that it learns from or is
judged by; their margins lie in the block and are written anew with every tree, so a pass walks the tree under way only and
workers keep nothing between tasks. A block tells the weights of all models by the kinds of rows in it and the kind of each
row, and holds the signs of the residuals beside the margins: they are all that a split under the absolute loss needs, so
four passes out of five read neither targets nor margins. A missing value has a bin of its own, and each split decides which
side it takes. Under the absolute loss, leaves take the weighted median of their residuals.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.settle import settle
from galeframe.session import prepare, remove_folder, shared_folder

BINS = 64  # of a feature, the one of missing values aside
MEDIAN_BINS = 1024
PARTS = {"x": np.uint8, "y": float, "kinds": np.float32, "kind": None, "margin": float, "sign": np.int8}
BLOCK = "rows int, " + ", ".join(f"{n} binary" for n in PARTS)
#: Blocks are large records: so many go to a worker at once, however many a task reads.
FEW_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    depth: int = 4
    rate: float = 0.2
    patience: int = 4
    least: float = 5.0  # weight of a child
    shrink: float = 1.0
    features: float = 0.8  # share of the features that a tree may use
    loss: str = "absolute"


@dataclass
class Trees:
    """One model: ``base`` and, by tree, the feature, the last bin to the left, whether missing goes left, and the leaf values."""

    base: float
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    missing: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, bins: np.ndarray, start: int, out: np.ndarray) -> np.ndarray:
        for f, c, m, leaf in zip(self.feature[start:], self.cut[start:], self.missing[start:], self.leaf[start:]):
            out = out + np.asarray(leaf).take(walk(bins, f, c, m, len(f).bit_length()))
        return out


def walk(bins: np.ndarray, feature: Sequence[int], cut: Sequence[int], missing: Sequence[bool], depth: int) -> np.ndarray:
    """Leaf of each row, counted from the left, after ``depth`` splits."""
    f, flat, row, node = np.asarray(feature, np.int64) * len(bins), bins.T.ravel(), np.arange(len(bins)), np.zeros(len(bins), np.int64)
    right = np.arange(256) > np.asarray(cut)[:, None]  # by node and bin
    right[:, 0] = ~np.asarray(missing, bool)
    right = right.astype(np.int64) + 1
    for level in range(depth):
        if level == 0:
            node = right[0].take(bins[:, feature[0]])
        else:
            node = 2 * node + right.ravel().take(256 * node + flat.take(row + f.take(node)))
    return node - ((1 << depth) - 1)


def quantile_edges(df: DataFrame, features: Sequence[str], target: Column, accuracy: int = 10_000) -> tuple[list[np.ndarray], tuple[float, float]]:
    """Upper edges of the bins of every feature, from mergeable sketches, and bounds of the target, from the same pass."""
    shares = [float(i) / BINS for i in range(1, BINS)]
    usual = [F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in features]
    y = target.cast("double")
    row = df.agg(*[F.percentile_approx(u, shares, accuracy).alias(f"_{i}") for i, u in enumerate(usual)], F.min(y).alias("_low"), F.max(y).alias("_high")).first()
    bounds = (0.0, 1.0) if row["_low"] is None else (float(row["_low"]), float(row["_high"]) + 1e-9)
    return [np.unique(np.array(row[f"_{i}"] or [], float)) for i in range(len(features))], bounds


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 is a missing value; the others count from 1."""
    out = np.zeros(x.shape, np.uint8, order="F")
    for k, e in enumerate(edges):
        there = ~np.isnan(x[:, k])
        out[there, k] = 1 + np.searchsorted(e, x[there, k], side="left")
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one length as a matrix; nulls become NaN."""
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def inputs(features: Sequence[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in features])


def blocks(df: DataFrame, features: Sequence[str], target: Column, weights: Sequence[Column], judged: Sequence[Column], edges: list[np.ndarray]) -> DataFrame:
    """Blocks of binned rows with target and weights of all models, dealt evenly to as many tasks as run at once; no margins yet."""
    m = len(weights)
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, w, v = (matrix(b.column(i), n) for i, n in ((0, width), (2, m), (3, m)))
                yield block_of(b.num_rows, binned(x, edges), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), *(np.nan_to_num(a).astype(np.float32).T for a in (w, v)))

    cols = [F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs]) for cs in (weights, judged)]
    rows = df.select(inputs(features).alias("x"), target.cast("double").alias("y"), cols[0].alias("w"), cols[1].alias("v"))
    return rows.filter("y IS NOT NULL AND NOT isnan(y)").mapInArrow(run, BLOCK).repartition(df.sparkSession.sparkContext.defaultParallelism)


def block_of(rows: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, margin: np.ndarray | bytes = b"", sign: np.ndarray | bytes = b"") -> pa.RecordBatch:
    """A block from (rows, features) bins and (models, rows) weights and judging weights. Rows of equal weights are of one kind."""
    size, raw, seen = 8 * len(w), np.concatenate([w, v]).T.astype(np.float32).tobytes(), {}
    kind = [seen.setdefault(raw[i:i + size], len(seen)) for i in range(0, len(raw), size)]
    return packed(rows, x, y, b"".join(seen), np.array(kind, np.min_scalar_type(len(seen))), margin, sign)


def packed(rows: int, x: np.ndarray, *parts: np.ndarray | bytes) -> pa.RecordBatch:
    arrays = [pa.array([p if isinstance(p, bytes) else p.tobytes()], pa.binary()) for p in (x.T, *parts)]
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.int32()), *arrays], ["rows", *PARTS])


@dataclass
class Block:
    """One block in memory, not copied out of the batch it came in; ``margins`` hold the first ``written`` trees of some models,
    ``signs`` those of the residuals of the rows these learn from. Features, targets or margins may not have been read."""

    x: np.ndarray  # (rows, features), a feature's bins one after the other
    y: np.ndarray | None
    kinds: np.ndarray  # (kinds, weight or judging weight, models)
    kind: np.ndarray
    margins: dict[int, np.ndarray]
    signs: dict[int, np.ndarray]
    written: int

    def weight(self, model: int, rows: np.ndarray, judging: int = 0) -> np.ndarray:
        return self.kinds[:, judging, model].astype(float).take(self.kind.take(rows))

    def learnt(self, model: int) -> np.ndarray:
        """The rows that a model learns from."""
        return np.flatnonzero((self.kinds[:, 0, model] != 0.0).take(self.kind))

    def own(self, model: int) -> np.ndarray:
        """The rows that a model learns from or is judged by."""
        return np.flatnonzero((self.kinds[:, :, model] != 0.0).any(1).take(self.kind))

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return self.x.T.take(rows, 1).T

    def part(self, model: int, tree: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A model's own rows, their bins and their margins after all trees of it."""
        own = self.own(model)
        x = self.bins(own)
        if model in self.margins:
            return own, x, tree.add(x, self.written, self.margins[model])
        return own, x, tree.add(x, 0, np.full(len(own), tree.base))


def blocks_of(batches: Iterator[pa.RecordBatch], width: int, models: int, told: Sequence[int], written: int) -> Iterator[Block]:
    """The blocks of batches; ``told`` are the models whose margins or signs lie in them, one after the other."""
    for b in batches:
        for i, n in enumerate(b.column(0).to_pylist()):
            raw = {name: b.column(name)[i].as_buffer() for name in b.schema.names[1:]}
            part = {name: np.frombuffer(r, PARTS[name] or f"u{r.size // n}") for name, r in raw.items()}
            block = Block(part["x"].reshape(width, n).T, part.get("y"), part["kinds"].reshape(-1, 2, models), part["kind"].astype(np.intp), {}, {}, written)
            for name, into, rows in (("margin", block.margins, block.own), ("sign", block.signs, block.learnt)):
                if told and name in part:
                    into.update(zip(told, np.split(part[name], np.cumsum([len(rows(m)) for m in told])[:-1])))
            yield block


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """The jobs started inside hand blocks to workers a few at a time, so memory does not grow with what a task reads."""
    before = {k: spark.conf.get(k) for k in FEW_AT_ONCE}
    try:
        for k, v in FEW_AT_ONCE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def gradient(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "absolute":
        return -np.sign(y - margin), np.ones_like(y)
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, np.maximum(p * (1.0 - p), 1e-6)


def lost(loss: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.abs(y - margin) if loss == "absolute" else np.logaddexp(0.0, margin) - y * margin


def histogram(x: np.ndarray, place: np.ndarray, nodes: int, weight: np.ndarray) -> np.ndarray:
    """(feature, node, bin) sums of the weights of rows at ``place``."""
    bins, width = BINS + 1, x.shape[1]
    first, size = place * bins, nodes * bins
    if len(place) < 2048:  # in one count, as a call costs more than the rows
        return np.bincount((x.T + first + np.arange(width)[:, None] * size).ravel(), np.tile(weight, width), width * size).reshape(width, nodes, bins)
    out = np.empty((width, size))
    for k, column in enumerate(x.T):
        out[k] = np.bincount(first + column, weight, size)
    return out.reshape(width, nodes, bins)


def histogram_by_sign(x: np.ndarray, place: np.ndarray, nodes: int, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums by the sign of the residual: one count tells gradients and weights under the absolute loss."""
    return histogram(x, place + nodes * (sign.astype(np.intp) + 1), 3 * nodes, weight).reshape(x.shape[1], 3, nodes, -1)


def gradient_sums(told: np.ndarray, loss: str) -> np.ndarray:
    """(node, feature, bin, 2) sums of gradients and second derivatives from the histograms of a loss."""
    if loss != "absolute":
        return told.transpose(2, 1, 3, 0)
    under, none, over = told.transpose(1, 2, 0, 3)
    return np.stack([under - over, under + none + over], -1)


def split(sums: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[list[int], list[int], list[bool], list[float]]:
    """Best split of each node from (node, feature, bin, 2) sums; a node without one sends everything to the left."""
    g, h = sums[..., 0], sums[..., 1]
    nodes, features, bins = g.shape
    total_g, total_h = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
    found = np.full((2, nodes, features, bins - 1), -np.inf)
    for side in (0, 1):  # missing to the right, to the left
        gl = g[:, :, 1:].cumsum(2) + (g[:, :, :1] if side else 0.0)
        hl = h[:, :, 1:].cumsum(2) + (h[:, :, :1] if side else 0.0)
        gr, hr = total_g - gl, total_h - hl
        gain = gl**2 / (hl + s.shrink) + gr**2 / (hr + s.shrink) - total_g**2 / (total_h + s.shrink)
        found[side] = np.where((hl >= s.least) & (hr >= s.least) & allowed[None, :, None], gain, -np.inf)
    flat = found.transpose(1, 0, 2, 3).reshape(nodes, -1)
    best = flat.argmax(1)
    gain = flat[np.arange(nodes), best]
    good = gain > 1e-9
    side, rest = np.divmod(best, features * (bins - 1))
    feature, cut = np.divmod(rest, bins - 1)
    return np.where(good, feature, 0).tolist(), np.where(good, cut + 1, 255).tolist(), (np.where(good, side, 1) == 1).tolist(), np.where(good, gain, 0.0).tolist()


def middle(weight: np.ndarray, low: float, high: float) -> float:
    """Weighted median from the weights of equal bins, linear within its bin."""
    run, half = weight.cumsum(), weight.sum() / 2.0
    if half <= 0.0:
        return 0.0
    k = int(np.searchsorted(run, half))
    width = (high - low) / len(weight)
    return low + width * (k + (half - (run[k] - weight[k])) / weight[k])


class Fit:
    """The passes of one fit over written blocks."""

    def __init__(self, df: DataFrame, *, features: Sequence[str], target: Column, weights: Sequence[Column], judged: Sequence[Column], settings: Settings, seeds: Sequence[int]):
        prepare(df.sparkSession)
        self.s, self.features, self.models, self.seeds = settings, list(features), len(weights), list(seeds)
        self.edges, self.bounds = quantile_edges(df, features, target)
        self.folder: str | None = None
        self._write(blocks(df, features, target, weights, judged, self.edges))
        self.trees = [Trees(0.0) for _ in weights]
        self.told, self.written = [], 0  # models whose margins lie in the blocks, and of how many trees

    def _write(self, table: DataFrame) -> None:
        """Blocks from now on; what they were read from is deleted."""
        old, self.folder = self.folder, shared_folder(table.sparkSession)
        self.rows = settle(table, self.folder)
        self.spark = table.sparkSession
        if old is not None:
            remove_folder(old)

    def _write_margins(self, active: list[int]) -> None:
        """Put the margins of all trees so far, and the signs of the residuals, into the blocks."""
        width, count, trees, told, written, signed = len(self.features), self.models, self.trees, self.told, self.written, self.s.loss == "absolute"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks_of(batches, width, count, told, written):
                margins, signs = [], []
                for m in active:
                    own, _, margin = b.part(m, trees[m])
                    margins.append(margin)
                    if signed:
                        use = np.flatnonzero(b.weight(m, own))
                        signs.append(np.sign(b.y[own[use]] - margin[use]).astype(np.int8))
                yield packed(len(b.y), b.x, b.y, b.kinds, b.kind.astype(np.min_scalar_type(len(b.kinds))), np.concatenate(margins), np.concatenate(signs) if signed else b"")

        with few_at_once(self.spark):
            self._write(self.rows.drop("sign").mapInArrow(run, BLOCK))
        self.told, self.written = list(active), len(trees[active[0]].leaf)

    def _pass(self, active: list[int], grown: dict[int, tuple], part: str, reach: tuple[float, float] = (0.0, 0.0)) -> dict[int, dict]:
        """One pass: ``split`` sums gradients for the next level and picks splits; ``leaf`` sums residuals for the leaf values;
        ``start`` sums the target. ``grown`` is the tree under way of each model."""
        s, width, bins, trees, count, seeds, stored, written = self.s, len(self.features), BINS + 1, self.trees, self.models, self.seeds, self.told, self.written
        low, high = reach
        level = len(next(iter(grown.values()))[0]).bit_length() if grown else 0
        nodes = 1 << level
        signs = part == "split" and s.loss == "absolute" and bool(stored) and all(len(trees[m].leaf) == written for m in active)

        def placed(model: int, x: np.ndarray) -> np.ndarray:
            return walk(x, *grown[model][:3], level) if level else np.zeros(len(x), np.intp)

        def one(model: int, block: Block) -> np.ndarray:
            if signs:
                use = block.learnt(model)
                x = block.bins(use)
                return histogram_by_sign(x, placed(model, x), nodes, block.signs[model], block.weight(model, use))
            own, x, margin = block.part(model, trees[model])
            y, w = block.y[own], block.weight(model, own)
            in_use = np.flatnonzero(w)
            told = []
            if part == "leaf":
                v = block.weight(model, own, 1)
                told = [(v * lost(s.loss, y, margin)).sum(), v.sum()]
            x, y, w, margin = x.T.take(in_use, 1).T, y[in_use], w[in_use], margin[in_use]
            place = placed(model, x)
            if part == "leaf" and s.loss == "absolute":
                at = np.clip(((y - margin) - low) / max(high - low, 1e-300) * MEDIAN_BINS, 0, MEDIAN_BINS - 1).astype(np.int64)
                return np.concatenate([told, np.bincount(place * MEDIAN_BINS + at, w, nodes * MEDIAN_BINS)])
            if part == "split" and s.loss == "absolute":
                return histogram_by_sign(x, place, nodes, np.sign(y - margin), w)
            g, h = gradient(s.loss, y, margin)
            if part == "leaf":
                return np.concatenate([told, *(np.bincount(place, a * w, nodes) for a in (g, h))])
            return np.stack([histogram(x, place, nodes, a * w) for a in (g, h)])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for block in blocks_of(batches, width, count, stored, written):
                for m in active:
                    found = one(m, block)
                    total[m] = total[m] + found if m in total else found
            if part == "split":
                total = {m: gradient_sums(a, s.loss) for m, a in total.items()}
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([a.tobytes() for a in total.values()], pa.binary())], ["model", "sums"])

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            m, sums = int(group["model"].iloc[0]), 0.0
            for x in group["sums"]:
                sums = sums + np.frombuffer(x)
            out = io.BytesIO()
            if part == "split":
                rng = np.random.default_rng([seeds[m], len(trees[m].leaf)])
                allowed = np.zeros(width, bool)
                allowed[rng.permutation(width)[:max(1, round(s.features * width))]] = True
                feature, cut, missing, gain = split(sums.reshape(nodes, width, bins, 2), allowed, s)
                np.savez(out, feature=feature, cut=cut, missing=missing, gain=gain)
            elif s.loss == "absolute":
                leaf = [middle(h, low, high) for h in sums[2:].reshape(nodes, MEDIAN_BINS)]
                np.savez(out, judged=sums[:2], leaf=leaf, weight=sums[2:].sum())
            else:
                g, h = sums[2:].reshape(2, nodes)
                np.savez(out, judged=sums[:2], leaf=-g / (h + s.shrink), weight=h.sum())
            return pd.DataFrame({"model": [m], "found": [out.getvalue()]})

        rows = self.rows.drop("y", "margin") if signs else self.rows.drop("sign")
        with few_at_once(self.spark):
            told = rows.mapInArrow(gather, "model int, sums binary").groupBy("model").applyInPandas(choose, "model int, found binary").collect()  # one row a model
        out = {}
        for r in told:
            with np.load(io.BytesIO(bytes(r["found"]))) as z:
                out[r["model"]] = {k: z[k] for k in z.files}
        return out

    def run(self, bounds: tuple[float, float]) -> list[Trees]:
        """Grow all models; ``bounds`` hold every target. Each keeps the trees up to its best round on the rows it is judged by."""
        s, every = self.s, list(range(self.models))
        reach = (bounds[0] - bounds[1], bounds[1] - bounds[0])
        first = self._pass(every, {}, "leaf", bounds)
        every = [m for m in every if m in first and first[m]["weight"] > 0.0]
        self.fitted = [m in every for m in range(self.models)]
        if not every:
            return self.trees
        for m in every:
            self.trees[m].base = float(first[m]["leaf"][0])
        best = dict.fromkeys(every, (np.inf, 0))
        active = every
        for turn in range(s.rounds + 1):
            grown: dict[int, tuple] = {m: ([], [], [], []) for m in active}
            for _ in range(s.depth if turn < s.rounds else 0):
                found = self._pass(active, grown if grown[active[0]][0] else {}, "split")
                for m in active:
                    for old, name in zip(grown[m], ("feature", "cut", "missing", "gain")):
                        old.extend(found[m][name].tolist())
            told = self._pass(active, grown if turn < s.rounds else {}, "leaf", reach)
            going = []
            for m in active:
                loss, weight = told[m]["judged"]
                value = loss / weight if weight > 0.0 else -float(turn)  # without judges, all rounds
                if value < best[m][0]:
                    best[m] = (value, turn)
                if turn < s.rounds and turn - best[m][1] < s.patience:
                    going.append(m)
                    t = self.trees[m]
                    for place, made in zip((t.feature, t.cut, t.missing, t.gain), grown[m]):
                        place.append(list(made))
                    t.leaf.append((s.rate * told[m]["leaf"]).tolist())
            active = going
            if not active:
                break
            if turn + 1 < s.rounds:  # the last tree's margins have one pass to serve
                self._write_margins(active)
        for m, (_, keep) in best.items():
            t = self.trees[m]
            for part in (t.feature, t.cut, t.missing, t.leaf, t.gain):
                del part[keep:]
        return self.trees


@dataclass
class Models:
    """Fitted models over the same inputs."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Trees]
    fitted: list[bool]
    loss: str

    def predictions(self) -> Column:
        """Array of the predictions of all models."""
        told, edges, trees, width, loss = prediction_of, self.edges, [vars(t) for t in self.trees], len(self.features), self.loss

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            models = [Trees(**t) for t in trees]
            for x in batches:
                values = np.array([np.asarray(r, float) for r in x]).reshape(-1, width)
                yield pd.Series(list(told(values, edges, models, loss)))
        return F.pandas_udf(run, "array<double>")(inputs(self.features))

    def importance(self, model: int) -> np.ndarray:
        """Share of the gain that each feature's splits brought."""
        out = np.zeros(len(self.features))
        for feature, gain in zip(self.trees[model].feature, self.trees[model].gain):
            np.add.at(out, feature, gain)
        return out / out.sum() if out.sum() > 0.0 else out


def prediction_of(x: np.ndarray, edges: Sequence[np.ndarray], models: Sequence[Trees], loss: str) -> np.ndarray:
    """(rows, models) predictions."""
    bins = binned(x, edges)
    margin = np.stack([t.add(bins, 0, np.full(len(x), t.base)) for t in models], 1)
    return margin if loss == "absolute" else 1.0 / (1.0 + np.exp(-margin))


def fit_models(df: DataFrame, *, features: Sequence[str], target: Column, weights: Sequence[Column], judged: Sequence[Column] | None = None, seeds: Sequence[int] | None = None,
               bounds: tuple[float, float] | None = None, settings: Settings = Settings()) -> Models:
    """One model for each of ``weights``. Rows without a target take no part; a model without rows of weight stays at 0 and
    is told by ``fitted``. ``judged`` weighs the rows each model stops early by; a model without such rows grows all rounds."""
    fit = Fit(df, features=features, target=target, weights=weights, judged=judged or [F.lit(0.0)] * len(weights), settings=settings, seeds=seeds or [0] * len(weights))
    trees = fit.run(fit.bounds if bounds is None else bounds)
    remove_folder(fit.folder)
    return Models(list(features), fit.edges, trees, fit.fitted, settings.loss)
