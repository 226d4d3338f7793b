"""Best-fit-decreasing packing of token ids into rows of a fixed length.

Documents longer than a row are cut into pieces without losing a token. A task packs its stream of documents in
buffers of bounded size: pieces go from the longest to the shortest into the fullest row that still holds them, found
by a segment tree over the free capacities. Nothing is shuffled, and a lost task packs its own input again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.bpe_fragments import read_tokenizer, worker_codec
from galeframe.llm.common import map_batches, slices

SCHEMA = ("n_tokens int, n_segments int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary")


class Capacities:
    """Rows by free capacity; the smallest sufficient capacity in logarithmic time."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.base + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with ``need`` places left, removed; None if there is none."""
        node = self.base + need
        while not self.count[node]:
            while node & 1:  # a right child has nothing larger beside it
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:  # beyond the last leaf of this depth
                return None
        while node < self.base:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.base
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes into ``sizes`` (each at most ``length``)."""
    free, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[i])
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > sizes[i]:
            free.add(capacity - sizes[i], row)
    return rows


def pack(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad_id: int) -> dict:
    """Columns of the packed rows of one buffer; ``pieces`` are (document, offset in it, ids)."""
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0, *(len(p[2]) for p in own)]).astype(np.int32)
        ids = np.full(length, pad_id, pieces[0][2].dtype)
        ids[:ends[-1]] = np.concatenate([p[2] for p in own])
        for name, value in (("n_tokens", int(ends[-1])), ("n_segments", len(own)), ("doc_ids", [p[0] for p in own]), ("doc_offsets", [p[1] for p in own]),
                            ("cu_seqlens", ends), ("position_resets", ends[:-1]), ("ids", ids.tobytes())):
            out[name].append(value)
    return out


def position_ids(cu_seqlens: np.ndarray) -> np.ndarray:
    """Positions within each segment, restarting at every reset."""
    sizes = np.diff(cu_seqlens)
    return np.arange(cu_seqlens[-1]) - np.repeat(cu_seqlens[:-1], sizes)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int | None = 49407, pad_id: int = 49407,
                   buffer_tokens: int = 1 << 22) -> DataFrame:
    """Packed rows: row_id, n_tokens, n_segments, doc_ids, doc_offsets (tokens before the piece in its document),
    cu_seqlens, position_resets and ids (one matrix row: ``length`` little-endian unsigned integers, 16 bits each if
    the vocabulary allows, else 32, filled up with ``pad_id``).

    Every token of every document is in exactly one row; ``end_id`` closes each document that has tokens. A missing or
    empty text is in no row, rows that repeat an id are packed each; a missing id stays missing. Other columns are not read.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = worker_codec(file.value)
        kind = "<u2" if len(codec.tokens) <= 1 << 16 else "<u4"
        pieces, held = [], 0
        for batch in slices(batches, "text", 6 << 20):
            for doc, coded in zip(batch.column("doc_id").to_pylist(), codec.encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(coded, "<u4").astype(kind)
                if len(ids) and end_id is not None:
                    ids = np.append(ids, np.array([end_id], kind))
                for s in range(0, len(ids), length):
                    pieces.append((doc, s, ids[s:s + length]))
                held += len(ids)
                if held >= buffer_tokens:
                    yield pack(pieces, length, pad_id)
                    pieces, held = [], 0
        if pieces:
            yield pack(pieces, length, pad_id)

    rows = map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, SCHEMA)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "*")
