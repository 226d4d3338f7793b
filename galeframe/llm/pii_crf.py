"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained on a small labelled table of lines, on the driver, by exact forward-backward gradients. Tasks cut
their texts into words with numpy, look up shape features and decode all segments of a batch at once by Viterbi, one
word position a step. A segment is a stretch of at most ``SEGMENT`` words of one line, so no word is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")
STATES = 1 + len(KINDS)  # 0: none of them
SEGMENT = 64

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive: what follows a class here is never of that class, so giving back would find nothing.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind, in order of start and kind."""
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- words and their shapes

LOWER, UPPER, DIGIT, AT, DOT, DASH, PLUS, OTHER = (1 << i for i in range(8))
SPACES = np.zeros(0x110000, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BITS = np.full(0x110000, LOWER, np.uint8)
BITS[:128] = OTHER
BITS[65:91], BITS[97:123], BITS[48:58] = UPPER, LOWER, DIGIT
BITS[[ord("@"), ord("."), ord("-"), ord("+"), ord("("), ord(")")]] = AT, DOT, DASH, PLUS, PLUS, PLUS
BITS[SPACES] = 0
FIRST_BIT = np.array([max(0, (b & -b).bit_length() - 1) for b in range(256)], np.int64)
LENGTHS, DIGITS = np.array([2, 3, 4, 5, 7, 10, 14, 16, 17, 20]), np.array([1, 2, 3, 4, 5, 10, 14, 16, 17, 20])
BLOCKS = (256, 64, (len(LENGTHS) + 1) * (len(DIGITS) + 1), 5 * 3, 256, 256)
OFFSETS = np.cumsum((0, *BLOCKS[:-1]))
N_FEATURES = sum(BLOCKS)


@dataclass
class Words:
    """Words of a joined text: code-point starts and ends, features, segment numbers and positions in the segment."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    segment: np.ndarray
    place: np.ndarray


def words_of(joined: str) -> Words:
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.concatenate([[True], SPACES[cp], [True]])
    turn = np.diff(space.view(np.int8))
    start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty((0, len(BLOCKS)), np.int64), none, none)
    bits = BITS[cp]
    mask = np.bitwise_or.reduceat(bits, start).astype(np.int64)

    def count(what: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(bits == what)])
        return total[end] - total[start]

    line = np.searchsorted(np.flatnonzero(cp == 10), start)
    index = np.arange(len(start))
    new_line = np.concatenate([[True], line[1:] != line[:-1]])
    in_line = index - np.maximum.accumulate(np.where(new_line, index, 0))
    before = np.where(new_line, 0, np.concatenate([[0], mask[:-1]]))
    after = np.where(np.append(new_line[1:], True), 0, np.append(mask[1:], 0))
    shape = FIRST_BIT[bits[start]] * 8 + FIRST_BIT[bits[end - 1]]
    size = np.searchsorted(LENGTHS, end - start, side="right") * (len(DIGITS) + 1) + np.searchsorted(DIGITS, count(DIGIT), side="right")
    marks = np.minimum(count(DOT), 4) * 3 + np.minimum(count(DASH), 2)
    features = np.stack([mask, shape, size, marks, before, after], 1) + OFFSETS
    place = in_line % SEGMENT
    return Words(start, end, features, np.cumsum(place == 0) - 1, place)


def _by_place(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order of place and of segment length: (order, first word of each place, segments at each place)."""
    size = np.bincount(w.segment)
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
    order = np.lexsort((rank[w.segment], w.place))
    count = np.bincount(w.place)
    return order, np.cumsum(count) - count, count


@dataclass
class Field:
    """Weights of the features for each state, and of each state following another."""

    weight: np.ndarray
    follow: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        out = self.weight[w.features[:, 0]]
        for k in range(1, len(BLOCKS)):
            out += self.weight[w.features[:, k]]
        return out

    def decode(self, w: Words) -> np.ndarray:
        """Most likely state of every word."""
        out = np.zeros(len(w.start), np.int8)
        if not len(out):
            return out
        order, first, count = _by_place(w)
        emit, back = self.emissions(w)[order], np.zeros((len(out), STATES), np.int8)
        best = emit[:count[0]]
        finals = [best]
        for p in range(1, len(count)):
            now = slice(first[p], first[p] + count[p])
            last = best[:count[p]]
            top, arg = last[:, 0, None] + self.follow[0], np.zeros((count[p], STATES), np.int8)
            for s in range(1, STATES):
                value = last[:, s, None] + self.follow[s]
                better = value > top
                top[better] = value[better]
                arg[better] = s
            back[now] = arg
            best = top + emit[now]
            finals.append(best)
        state = np.zeros(0, np.int8)
        for p in range(len(count) - 1, -1, -1):
            ending = finals[p][len(state):].argmax(1).astype(np.int8)  # segments whose last word stands here
            state = np.concatenate([state, ending])
            out[order[first[p]:first[p] + count[p]]] = state
            if p:
                state = back[first[p] + np.arange(count[p]), state]
        return out


def train(lines: list[str], labels: list[list[Span]], *, rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum-likelihood weights from labelled lines; a word carries the kind of the span it touches."""
    joined = "\n".join(x.replace("\n", " ") for x in lines)
    w = words_of(joined)
    weight, follow = np.zeros((N_FEATURES, STATES), np.float32), np.zeros((STATES, STATES), np.float32)
    field = Field(weight, follow)
    if not len(w.start):
        return field
    truth = np.zeros(len(w.start), np.int64)
    offset = 0
    for line, spans in zip(lines, labels):
        for s, k, e in spans:
            truth[np.searchsorted(w.end, offset + s, side="right"):np.searchsorted(w.start, offset + e)] = k + 1
        offset += len(line) + 1
    order, first, count = _by_place(w)
    truth, features = truth[order], w.features[order]
    sums = [np.zeros_like(weight), np.zeros_like(follow)]
    for _ in range(rounds):
        emit = field.emissions(w)[order].astype(np.float64)
        local, move = np.exp(emit - emit.max(1, keepdims=True)), np.exp(field.follow.astype(np.float64))
        forward, backward = np.zeros_like(local), np.ones_like(local)
        at = [slice(f, f + c) for f, c in zip(first, count)]
        forward[at[0]] = local[at[0]]
        for p in range(len(at)):
            if p:
                forward[at[p]] = forward[at[p - 1]][:count[p]] @ move * local[at[p]]
            forward[at[p]] /= forward[at[p]].sum(1, keepdims=True)
        pairs, seen = np.zeros((STATES, STATES)), np.zeros((STATES, STATES))
        for p in range(len(at) - 1, 0, -1):
            reach = backward[at[p]] * local[at[p]]
            b = reach @ move.T
            left = forward[at[p - 1]][:count[p]]
            total = (left * b).sum(1, keepdims=True)
            pairs += (left / total).T @ reach * move
            np.add.at(seen, (truth[at[p - 1]][:count[p]], truth[at[p]]), 1)
            backward[first[p - 1]:first[p - 1] + count[p]] = b / b.sum(1, keepdims=True)
        share = forward * backward
        share /= share.sum(1, keepdims=True)
        share[np.arange(len(truth)), truth] -= 1
        grad = np.zeros_like(weight)
        for k in range(len(BLOCKS)):
            for s in range(STATES):
                grad[:, s] -= np.bincount(features[:, k], share[:, s], N_FEATURES).astype(np.float32)
        for value, g, total in ((field.weight, grad - decay * field.weight, sums[0]), (field.follow, (seen - pairs).astype(np.float32) - decay * field.follow, sums[1])):
            total += g * g
            value += rate * g / (np.sqrt(total) + 1e-6)
    return field


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """Per text, the decoded spans that touch no base span; marks at their ends are cut off."""
    out: list[list[Span]] = [[] for _ in texts]
    joined = "\n".join(texts)
    w = words_of(joined)
    state = field.decode(w)
    at = np.flatnonzero(state)
    if not len(at):
        return out
    joins = (np.diff(at) == 1) & (state[at[1:]] == state[at[:-1]]) & (w.place[at[1:]] > 0)
    heads = np.flatnonzero(np.concatenate([[True], ~joins]))
    tails = np.append(heads[1:], len(at)) - 1
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for h, t in zip(at[heads].tolist(), at[tails].tolist()):
        s, e = int(w.start[h]), int(w.end[t])
        body = joined[s:e]
        e -= len(body) - len(body.rstrip(".,;:!?\"')]}>"))
        s += len(body) - len(body.lstrip("\"'([{<"))
        d = int(np.searchsorted(starts, s, side="right")) - 1
        s, e = s - int(starts[d]), e - int(starts[d])
        if e > s and not any(b[0] < e and s < b[2] for b in base[d]):
            out[d].append((s, int(state[h]) - 1, e))
    return out


def labelled_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_docs: int = 2000, max_lines: int = 800, max_chars: int = 1000) -> DataFrame:
    """A small labelled table (line, spans) when there is none: lines of at most ``max_docs`` documents (those whose id
    hashes lowest), at most ``max_lines`` with a digit or @ and as many without, of at most ``max_chars`` code points,
    labelled by the fixed patterns."""
    ids = docs.select(F.col(doc_id).alias("_id")).filter("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(ids), "_id")  # max_docs rows at most
    lines = some.select(F.explode(F.split("_text", "\n", -1)).alias("line")).filter(F.char_length("line").between(1, max_chars)).distinct()
    told = F.col("line").rlike("[0-9@]")
    lines, other = (lines.filter(c).orderBy(F.xxhash64("line"), "line").limit(max_lines) for c in (told, ~told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"line": batch.column("line"), "spans": [span_text(base_spans(t)) for t in batch.column("line").to_pylist()]}
    return map_batches(lines.union(other), run, "line string, spans string")


def fit_field(labelled: DataFrame, max_lines: int = 4000) -> Field:
    """A field from a table (line, spans as kind:start:end, comma-joined), of which at most ``max_lines`` rows are read."""
    rows = labelled.select("line", "spans").filter("line IS NOT NULL").limit(max_lines).collect()
    rows = sorted((r["line"], r["spans"] or "") for r in rows)
    spans = [[(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in text.split(",") if x)] for _, text in rows]
    return train([line for line, _ in rows], spans)


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added ones, by start).

    A missing text is empty and has no spans. Rows stand alone, so repeated rows and ids give repeated results; other
    columns are not read. Without personal data in the labelled table the field adds nothing.
    """
    if labelled is None:
        labelled = labelled_lines(docs, doc_id=doc_id, text=text)
    weights = docs.sparkSession.sparkContext.broadcast(vars(fit_field(labelled)))  # a fixed number, as plain arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        field = Field(**weights.value)
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            out = {"doc_id": batch.column("doc_id"), "base_sha256": [hashlib.sha256(span_text(b).encode()).hexdigest() for b in base],
                   "spans": [span_text(sorted(b + m)) for b, m in zip(base, more)]}
            yield out | {f"n_{k}": [sum(s[1] == i for s in b) for b in base] for i, k in enumerate(KINDS)}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)
