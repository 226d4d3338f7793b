"""Line de-duplication over levelled sorted runs of line hashes. Built-in expressions only.

A line's key is the line without white space at its ends, ASCII letters lower-cased; the 128 bits kept of it are two
xxhash64 values. Documents are taken in batches from the largest ids down. A batch is reduced to one row per key and
merge-joined with the runs: keys that no run holds (the anti part) become a new sorted run, keys seen before (the
rest) only add to a log of sightings. Runs therefore hold disjoint keys. When a level has ``fanout`` runs they are
merged into one run of the next level, so a batch meets a number of runs that is logarithmic in the batches so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.common import stash

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def ascii_lower(c: Column) -> Column:
    """A-Z only; text without other letters takes the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_array(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def row_id(doc_id: str) -> Column:
    """The id as a number; a missing one counts as the smallest. With a hash of the text it tells rows apart that repeat an id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def line_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """One row per line with a long enough key: _doc, _hash, pos, h1, h2, first (of its key in the row)."""
    trimmed = F.filter(F.transform(line_array(text), lambda x, i: F.struct(F.trim(x, F.lit(SPACE)).alias("k"), i.alias("pos"))), lambda x: F.char_length(x.k) >= min_chars)
    lowered = F.transform(F.col("_lines"), lambda x: F.struct(ascii_lower(x.k).alias("k"), x.pos.alias("pos")))
    hashed = F.sort_array(F.transform(F.col("_lines"), lambda x: F.struct(F.xxhash64(x.k).alias("h1"), F.xxhash64(F.lit(1), x.k).alias("h2"), x.pos.alias("pos"))))

    def flagged(x: Column, i: Column) -> Column:
        before = F.get("_lines", i - 1)
        return F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"), F.coalesce((before.h1 != x.h1) | (before.h2 != x.h2), F.lit(True)).alias("first"))

    rows = docs.select(row_id(doc_id).alias("_doc"), F.xxhash64(text).alias("_hash"), trimmed.alias("_lines"))
    rows = rows.select("_doc", "_hash", lowered.alias("_lines")).select("_doc", "_hash", hashed.alias("_lines"))
    return rows.select("_doc", "_hash", F.inline(F.transform("_lines", flagged)))


class LineRuns:
    """The levelled store: add batches of line rows, read totals per key."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.sightings: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join a batch with the runs, keep what is new as a run, and return those new keys."""
        keys = lines.groupBy(*KEY).agg(F.sum(F.col("first").cast("long")).alias("n_docs"), F.max("_doc").alias("last_doc"))
        known = self._union(self.runs())
        if known is None:
            fresh = stash(keys.sortWithinPartitions(*KEY))
        else:
            marked = stash(keys.join(known.select(*KEY, F.lit(True).alias("seen")).hint("merge"), KEY, "left").sortWithinPartitions(*KEY))
            fresh = marked.filter(F.col("seen").isNull()).drop("seen")
            self.sightings.append(marked.filter("seen").drop("seen"))
        self._push(fresh, 0)
        return fresh

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._union(self.levels[level]).repartition(*KEY).sortWithinPartitions(*KEY)
            self.levels[level] = []
            self._push(stash(merged), level + 1)

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, last_doc over everything added."""
        return self._union(self.runs() + self.sightings).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame | None:
        out = None
        for t in tables:
            out = t if out is None else out.unionByName(t)
        return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Documents with columns ``kept`` (the lines that stay, joined by a line feed), ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` rows loses all its lines but those of the
    largest id holding it. A missing or empty text is one empty line. Rows that repeat an id each count as a document
    and stay together, a missing id counts as smaller than any other; other columns pass through untouched, but those
    named like the new ones give way.
    """
    spark = docs.sparkSession
    lines = line_table(docs, doc_id=doc_id, text=text, min_chars=min_chars)
    low, high = docs.agg(F.min(F.col(doc_id).cast("long")), F.max(F.col(doc_id).cast("long"))).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 1) // batches))
    batch = F.greatest(F.lit(0), F.floor((F.lit(high).cast("decimal(20,0)") - F.col("_doc")) / F.lit(width).cast("decimal(20,0)")).cast("long"))
    lines = stash(lines.withColumn("batch", F.least(F.lit(batches - 1), batch).cast("int")))
    store = LineRuns(spark, fanout)
    for b in range(batches):
        store.add(lines.filter(F.col("batch") == b))
    # written out, so that the join below has two plain shuffled sides and a very common line is split over tasks
    repeated = stash(store.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"))
    drops = (lines.select(*KEY, "_doc", "_hash", "pos").join(repeated.hint("merge"), KEY).filter(F.col("_doc") < F.col("last_doc"))
             .groupBy("_doc", "_hash").agg(F.collect_set("pos").alias("_drops")))
    # the text crosses the shuffle once, beside the other columns
    rest = [c for c in docs.columns if c not in (text, "kept", "n_lines", "n_dropped")]
    out = docs.select(F.struct(*rest).alias("_row"), F.col(text).alias("_text"), row_id(doc_id).alias("_doc"), F.xxhash64(text).alias("_hash"))
    out = out.join(drops.hint("shuffle_hash"), ["_doc", "_hash"], "left").withColumn("_lines", line_array("_text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops")), lambda i: F.get("_lines", i))
    own = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c == text or c in rest]
    return out.select(*own, F.when(F.col("_drops").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept"),
                      F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))
