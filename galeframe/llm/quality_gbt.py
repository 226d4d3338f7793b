"""Quality score of documents: histogram gradient-boosted trees over document statistics.

The trees are grown by numpy on a bounded sample of labelled documents and flattened into arrays (feature, bin, leaf
value; the children of node i are 2i + 1 and 2i + 2). Tasks compute each document's statistics from its whole text and
walk all trees for a batch of documents at once, one level a step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, release_memory, slices, small_batches

STATISTICS = ("log_bytes", "log_words", "bytes_per_word", "upper", "digit", "space", "beyond_ascii", "stop_marks", "pipe", "hash_marks", "other_marks", "distinct_words", "herdan",
              "repeated_next", "upper_words", "title_words", "marked_words", "log_lines", "words_per_line", "repeated_lines", "packed", "longest_word")
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_STOPS, _HASHES = list(b".,;:?'\"()-"), list(b"#$%&*@^~+=<>\\/_{}[]`!")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; an empty or missing one gives zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(data), len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    stops, hashes, pipes = int(count[_STOPS].sum()), int(count[_HASHES].sum()), int(count[124])
    spaces = int(count[9:14].sum() + count[32])
    lines = data.split(b"\n")
    distinct = len(set(words))
    return [np.log1p(n), np.log1p(w), n / w, count[_UPPER].sum() / letters, count[_DIGIT].sum() / n, spaces / n, count[128:].sum() / n, stops / w, pipes / w, hashes / w,
            (n - spaces - stops - hashes - pipes - letters - count[_DIGIT].sum() - count[128:].sum()) / w, distinct / w, np.log1p(distinct) / np.log1p(w),
            sum(map(eq, words, words[1:])) / w, sum(map(bytes.isupper, words)) / w, sum(map(bytes.istitle, words)) / w, 1 - sum(map(bytes.isalnum, words)) / w, np.log1p(len(lines)),
            w / len(lines), 1 - len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / n, np.log1p(max(map(len, words)))]


@dataclass
class Forest:
    """Flattened trees of one depth; ``edges`` are the cut points of each statistic's bins."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        b, node, tree = self.bins(x), np.zeros((len(x), trees), np.int64), np.arange(trees)
        rows = np.arange(len(x))[:, None]
        while node[0, 0] < inner:
            node = 2 * node + 1 + (b[rows, self.feature[tree, node]] > self.cut[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, most_bins: int = 64, shrink: float = 1.0, least: float = 1.0) -> Forest:
    """Boosted trees for 0/1 labels; one class or no rows give a forest that says the share of label 1."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, features, inner = float(np.log(p / (1 - p))), x.shape[1], 2**depth - 1
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, most_bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(features)]
    out = Forest(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), base)
    if len(np.unique(y)) < 2:
        return out
    b, margin = out.bins(x), np.full(len(y), base)
    wide = most_bins + 1
    code = b + wide * np.arange(features)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), wide, np.int64), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            at, first = 2**level, 2**level - 1
            local = node - first
            cells = (local[:, None] * (features * wide) + code).ravel()
            sums = [np.bincount(cells, np.repeat(v, features), at * features * wide).reshape(at, features, wide).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(at, -1).argmax(1)
            useful = gain.reshape(at, -1)[np.arange(at), best] > 1e-6
            feature[t, first:first + at] = np.where(useful, best // wide, 0)
            cut[t, first:first + at] = np.where(useful, best % wide, wide)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = (np.bincount(node - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -rate * gs / (hs + shrink)
        margin += leaf[t][node - inner]
    return Forest(edges, feature, cut, leaf, base)


def held_out(doc_id: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Forest:
    """Trees for ``labels`` outside the held-out quarter, from at most ``max_rows`` labels (those whose id hashes lowest)."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # max_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, "text"):
            yield {"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("label"), "x": [statistics(t) for t in batch.column("text").to_pylist()]}

    found = map_batches(met, run, "doc_id long, label int, x array<double>").orderBy("doc_id", "label", "x").limit(2 * max_rows).collect()
    return grow(np.array([r["x"] for r in found]).reshape(-1, len(STATISTICS)), np.array([r["label"] for r in found], float))


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", score: str = "score", predicted: str = "predicted", **settings) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on); own columns of
    these names give way, so other names can be given.

    A missing or empty text has zero statistics and a score like any other; rows are scored one by one, so repeated rows
    and ids agree. Without usable labels the score is the share of label 1, or a half. Other columns pass through.
    """
    small_batches(docs.sparkSession)
    arrays = docs.sparkSession.sparkContext.broadcast(vars(fit_quality(docs, labels, doc_id=doc_id, text=text, **settings)))  # a fixed number of nodes

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest = Forest(**arrays.value)
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            yield pd.Series(forest.score(x))
        release_memory()

    own = [c for c in docs.columns if c not in (score, predicted)]
    scored = docs.select(*own, F.pandas_udf(run, "double")(F.col(text).cast("string")).alias(score))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
