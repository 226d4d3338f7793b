"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of bounded size inside their partitions. A shard's words become numbers of the
benchmark's vocabulary (0: a word no item has), and its suffix array holds every position that a window could match:
those followed by enough known words. The benchmark's suffixes, as many words long as a window, are found in it by
bisection, all at once; an equal range of suffixes gives all places of a verbatim match. Windows that match one after
the other join to the longest match. Nothing is shuffled: what goes to the tasks is a block of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.common import map_batches, slices, stash

WINDOW = 10
#: Every byte that is no word character becomes a space; A-Z become a-z; bytes of other letters stay.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """A block of the benchmark: vocabulary, distinct windows in packed form, and the items and offsets of each."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        self.size, self.vocab = size, {}
        where: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for s in range(max(1, len(ids) - size + 1) if ids else 0):
                where.setdefault(tuple(ids[s:s + size]), []).append((item, s))
        self.shortest = min(map(len, where), default=0)
        self.bits = max(1, len(self.vocab).bit_length())
        grid = np.zeros((len(where), size), np.int64)
        top = np.full((len(where), size), (1 << self.bits) - 1, np.int64)
        for i, w in enumerate(where):
            grid[i, :len(w)] = top[i, :len(w)] = w
        self.low, self.high = self.pack(grid), self.pack(top)
        self.length = np.fromiter(map(len, where), np.int64, len(where))
        self.places = list(where.values())

    def pack(self, grid: np.ndarray) -> np.ndarray:
        """Several words to one 64-bit column, so that comparing columns compares words."""
        per = 62 // self.bits
        cols = []
        for c in range(0, self.size, per):
            col = np.zeros(len(grid), np.int64)
            for k in range(c, c + per):
                col = (col << self.bits) | (grid[:, k] if k < self.size else 0)
            cols.append(col)
        return np.stack(cols, 1) if cols else np.zeros((len(grid), 0), np.int64)


def suffix_array(tokens: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Positions followed by enough known words, in the order of their suffixes, and those suffixes packed."""
    n = len(tokens)
    padded = np.concatenate([tokens, np.zeros(win.size, tokens.dtype)])
    stop = np.where(padded == 0, np.arange(len(padded)), len(padded))
    stop = np.minimum.accumulate(stop[::-1])[::-1][:n]
    known = stop - np.arange(n)
    at = np.flatnonzero(known >= win.shortest)
    grid = np.empty((len(at), win.size), np.int64)
    for k in range(win.size):
        grid[:, k] = np.where(known[at] > k, padded[at + k], 0)
    packed = win.pack(grid)
    order = np.lexsort(packed.T[::-1])
    return at[order], packed[order]


def _bisect(packed: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted row, how many sorted rows are smaller (or not larger, if ``after``)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(packed), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(packed) - 1)
        less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for c in range(packed.shape[1]):
            x, y = packed[mid, c], wanted[:, c]
            less |= equal & (x < y)
            equal &= x == y
        right = open_ & (less | equal if after else less)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def search(tokens: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every verbatim occurrence of a window."""
    at, packed = suffix_array(tokens, win)
    if not len(at) or not len(win.length):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = _bisect(packed, win.low, False), _bisect(packed, win.high, True)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return at[np.repeat(low, count) + inside], which


def _shard(docs: list[np.ndarray], win: Windows) -> list[dict]:
    """Per document: hit spans (words, end exclusive), matching items, longest verbatim match in words."""
    gap = np.zeros(1, np.int32)
    tokens = np.concatenate([x for d in docs for x in (d, gap)])
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    pos, which = search(tokens, win)
    cover = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + win.length[which], -1)
    hit = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
    turn = np.diff(hit)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    out = [{"spans": [], "items": set(), "longest": 0} for _ in docs]
    for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(starts, begin, side="right") - 1).tolist()):
        out[d]["spans"].append((b - int(starts[d]), e - int(starts[d])))
    if len(pos):
        doc = np.searchsorted(starts, pos, side="right") - 1
        chain: dict[tuple[int, int, int], tuple[int, int]] = {}
        for p, w, d in sorted(zip(pos.tolist(), which.tolist(), doc.tolist())):
            n = int(win.length[w])
            for item, s in win.places[w]:
                out[d]["items"].add(item)
                last, first = chain.get((d, item, p - s), (-2, p))
                first = first if last == p - 1 else p
                chain[(d, item, p - s)] = (p, first)
                out[d]["longest"] = max(out[d]["longest"], p - first + n)
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    block, held = [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "") // 4 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


FOUND = "struct<spans:array<struct<start:int,end:int>>,items:array<bigint>,longest:int,n_words:bigint>"


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 block_words: int = 1 << 21, shard_words: int = 1 << 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``found``: spans of hit words (word numbers, end exclusive), matching items, the longest verbatim match, n_words.

    An item's windows are its runs of ``window`` words, or all its words if it has fewer; a missing or wordless text has
    none. The benchmark is taken in blocks of about ``block_words`` words, one pass over the documents for each, so the
    tasks' share of it is bounded. Repeated items both match; a repeated or missing item id is listed once.
    """
    names = docs.columns
    out = docs.withColumn("found", F.lit(None).cast(FOUND))
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block = next(blocks, [])
    while (following := next(blocks, None)) is not None:
        out, block = stash(_pass(out, Windows(block, window), text, shard_words, True)), following
    out = _pass(out, Windows(block, window), text, shard_words, keep_text)
    return out.select(*(n for n in names if keep_text or n != text), "found")


def _pass(docs: DataFrame, win: Windows, text: str, shard_words: int, keep_text: bool) -> DataFrame:
    schema = T.StructType([f for f in docs.schema if keep_text or f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        tokens: list[np.ndarray] = []

        def flush() -> Iterator[dict]:
            rows = iter(_shard(tokens, win))
            sizes = iter(tokens)
            for b in held:
                found = []
                for before in b.column("found").to_pylist():
                    r, n = next(rows), len(next(sizes))
                    spans, items, longest = r["spans"], r["items"], r["longest"]
                    if before:
                        spans = _merge(spans + [(s["start"], s["end"]) for s in before["spans"]])
                        items, longest = items | set(before["items"]), max(longest, before["longest"])
                    found.append({"spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items, key=lambda i: (i is None, i)), "longest": longest, "n_words": n})
                yield {name: b.column(name) for name in schema.names} | {"found": found}
            held.clear()
            tokens.clear()

        total, get = 0, win.vocab.get
        for batch in slices(batches, text):
            held.append(batch)
            for t in batch.column(text).to_pylist():
                ws = words_of(t)
                tokens.append(np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)))
                total += len(ws)
            if total >= shard_words:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return map_batches(docs, run, schema)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside a window's occurrence), n_items, items_sha256, contaminated, longest_match, spans."""
    rows = find_matches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark, keep_text=False, **settings)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    named = F.array_join(F.array_sort(F.transform(F.filter("found.items", lambda i: i.isNotNull()), lambda i: i.cast("string"))), ",")
    return rows.select("doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
                       (F.size("found.spans") > 0).alias("contaminated"), F.col("found.longest").alias("longest_match"), F.col("found.spans").alias("spans"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **settings) -> DataFrame:
    """The rows no window occurs in, columns unchanged; rows without text stay."""
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.col(text).cast("string").alias("text"), F.struct(F.lit(True).alias("_"), *(F.col(c) for c in others)).alias("row"))
    kept = find_matches(packed, benchmark, **settings).filter(F.size("found.spans") == 0)
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
