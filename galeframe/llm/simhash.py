"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at three or fewer differing bits agree in
one segment up to one bit, so they share one of its 32 one-wildcard variants. Distinct fingerprints are indexed under
their 64 variants, equal variants meet in sorted runs, and each meeting is verified on all 64 bits. A run is searched
breadth first over what is not linked yet and gives a spanning forest, never all its pairs; a very large run is first
cut again by the one-wildcard variants of the other segment's halves. Links become components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, settled_keys, slices, stash
from galeframe.llm.components import connected

SEED, SHINGLE, REACH = 42, 3, 3
SHORT_RUN, LARGE_RUN = 32, 4096


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches, "text"):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield {**{name: batch.column(name) for name in batch.schema.names if name != "text"}, "fp": prints.view(np.int64)}


def _near(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) <= REACH


def _forest(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the fingerprints within reach of each other; each is expanded once."""
    out, rest = [], f
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for a in front:
                hit = _near(rest ^ a)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    out.append((np.full(len(found), a), found))
                    queue.append(found)
                if not len(rest):
                    break
    return out


def _large_run(f: np.ndarray, segment: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The other segment differs in three bits at most, so one of its halves in one at most: cut by that half's variants."""
    other, out = (f >> np.uint64(32 * (1 - segment))) & np.uint64(0xFFFFFFFF), []
    for half in range(2):
        bits = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        for j in range(16):
            masked = bits & np.uint64(0xFFFF ^ (1 << j))
            order = np.argsort(masked, kind="stable")
            edges = np.flatnonzero(np.diff(masked[order])) + 1
            for part in np.split(f[order], edges):
                out += _forest(part)
    return out


def _run_links(key: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
        yield from (_forest(f[s:s + n]) if n <= LARGE_RUN else _large_run(f[s:s + n], int(key[s] >> 37)))
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    key, f = key[short], f[short]
    segment, wild = (key >> 37).astype(np.uint64), (key >> 32) & 31
    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        x = f[at] ^ f[at + step]
        mine = (x >> (np.uint64(32) * segment[at])) & np.uint64(0xFFFFFFFF)
        # a pair with equal segments meets under all 32 variants; it counts under the first
        ok = _near(x) & ((mine != 0) | (wild[at] == 0))
        yield f[at[ok]], f[at[ok] + step]
        step += 1


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    key, f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def found(key: np.ndarray, f: np.ndarray) -> Iterator[dict]:
        for a, b in _run_links(key, f):
            if len(a):
                yield {"u": a.view(np.int64), "v": b.view(np.int64)}

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        f = np.concatenate([f, batch.column("fp").to_numpy().view(np.uint64)])
        if len(key):
            whole = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            yield from found(key[:whole], f[:whole])
            key, f = key[whole:], f[whole:]
    yield from found(key, f)


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): key packs the segment, the wildcard's position and the segment without that bit."""
    out = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return out.select("fp", F.expr("shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L & ~shiftleft(1L, i % 32))").alias("key"))


def _rooted(prints: DataFrame) -> DataFrame:
    """fp, least (smallest id), root (one fingerprint of the component) for every distinct fingerprint."""
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    met = variants(classes).repartition("key").sortWithinPartitions("key")
    stars = connected(map_batches(met, _links, "u long, v long"))
    return classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links) for every row.

    A missing or empty text has no words and the fingerprint zero, linked like any other; repeated rows and ids fall
    into one component; a missing id stays missing and never names a component others have ids for. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = stash(map_batches(docs, _fingerprints, "doc_id long, fp long"))
    rooted = _rooted(prints)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return (prints.join(named.hint("merge"), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each component, with the smallest id; columns are unchanged.

    Rows are told apart by id and text, so rows that repeat an id with other texts belong each to its own component.
    """
    identity = [F.col(doc_id).isNull(), F.col(doc_id).cast("long"), F.col(text).isNull(), F.col(text).cast("string")]
    keys = {"_p": F.xxhash64(F.lit(0), *identity), "_q": F.xxhash64(F.lit(1), *identity)}
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(k.alias(n) for n, k in keys.items()))
    prints = stash(map_batches(keyed, _fingerprints, "doc_id long, _p long, _q long, fp long"))
    rows = stash(prints.join(_rooted(prints).select("fp", "root").hint("merge"), "fp").groupBy("root", "doc_id", "_p", "_q").agg(F.count("*").alias("n")))
    first = stash(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_p", "_q", "n")).alias("f")).select("f._p", "f._q", "f.n"))
    # Texts meet tables of keys whose size is known, and are shuffled only where these are too many to broadcast. Of rows
    # that are equal in id and text, only such rows travel to be told apart.
    gone = settled_keys(rows.select("_p", "_q").join(first, ["_p", "_q"], "left_anti"))
    repeated = settled_keys(first.filter("n > 1").select("_p", "_q"))
    named = docs.select(F.struct("*").alias("_row"), *(k.alias(n) for n, k in keys.items()))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    single = named.join(gone, ["_p", "_q"], "left_anti")
    if repeated.isEmpty():
        return single.select(*own)
    once = named.join(repeated, ["_p", "_q"], "left_semi").dropDuplicates(["_p", "_q"])
    return single.join(repeated, ["_p", "_q"], "left_anti").select(*own).union(once.select(*own))
