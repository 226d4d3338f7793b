"""Row-counted windows that do not put a whole site into one task.

The reference semantics count rows, not hours, so a frame of n rows may span
any amount of time. To run such frames in parallel inside one long site:

1. ``with_row_number`` numbers the rows of each site without sorting the site
   in one task: rows are numbered inside (site, time chunk) and shifted by the
   number of rows in earlier chunks, which is a prefix sum over a small table.
2. ``run_blocked`` cuts the numbering into blocks, copies only the rows a frame
   can reach into the neighbouring blocks, evaluates the window per
   (site, block) and keeps the block's own rows. Results equal a window over
   the whole site.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from galeframe.config import SITE, TS
from galeframe.functions.nullsafe import join_null_safe

ROW = "_row"
BLOCK = "_block"
OWN = "_own"
CHUNK = "_chunk"

CHUNK_SECONDS = 60 * 86_400
BLOCK_ROWS = 2_000


def epoch(ts: str = TS) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def with_row_number(
    df: DataFrame,
    *,
    keys: Sequence[str] = (SITE,),
    order: str = TS,
    name: str = ROW,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add the zero-based position of each row inside its key, ordered by time.

    (keys, order) must be unique. A chunk holds at most ``chunk_seconds``
    worth of rows, so no sort sees more than that. Rows without a key or a time
    are numbered too, those without a time first.
    """
    keys = list(keys)
    chunked = df.withColumn(CHUNK, F.floor(epoch(order) / F.lit(chunk_seconds)))
    w_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(w_chunks), F.lit(0)).alias("_before"))
    )
    w_rows = Window.partitionBy(*keys, CHUNK).orderBy(order)
    numbered = chunked.withColumn("_in_chunk", F.row_number().over(w_rows) - 1)
    return (
        join_null_safe(numbered, offsets, [*keys, CHUNK])
        .withColumn(name, (F.col("_before") + F.col("_in_chunk")).cast("long"))
        .drop("_before", "_in_chunk", CHUNK)
    )


def with_blocks(
    df: DataFrame, *, back: int, ahead: int = 0, row: str = ROW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Copy each row into every block whose frames can reach it."""
    own = F.floor(F.col(row) / block_rows)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(row) - ahead) / block_rows))
    last = F.floor((F.col(row) + back) / block_rows)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(OWN, F.col(BLOCK) == own)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions, kept apart.

    For stages that run Python per group: their cost is in the work, not in the
    bytes that adaptive coalescing goes by.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])


def run_blocked(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Mapping[str, Column]]],
    *,
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = (SITE,),
    order: str = TS,
    block_rows: int = BLOCK_ROWS,
    keep_row: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows before and ``ahead`` after.

    ``build`` receives the ordered window and returns column groups that are
    applied one after another, so a later group may use an earlier one; the
    reach of chained frames adds up and must be included in ``back``/``ahead``.
    """
    numbered = df if ROW in df.columns else with_row_number(df, keys=keys, order=order)
    blocked = with_blocks(numbered, back=back, ahead=ahead, block_rows=block_rows)
    w = Window.partitionBy(*keys, BLOCK).orderBy(ROW)
    for group in build(w):
        blocked = blocked.withColumns(dict(group))
    out = blocked.filter(F.col(OWN)).drop(BLOCK, OWN)
    return out if keep_row else out.drop(ROW)


def lag(c: str | Column, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w)


def lead(c: str | Column, n: int, w: WindowSpec) -> Column:
    return F.lead(c, n).over(w)


def diff(c: str, n: int, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c, n).over(w)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def roll_mean(c: str, n: int, w: WindowSpec, min_rows: int = 1) -> Column:
    f = trailing(w, n)
    mean = F.avg(c).over(f)
    return mean if min_rows <= 1 else F.when(F.count(c).over(f) >= min_rows, mean)


def roll_std(c: str, n: int, w: WindowSpec, min_rows: int = 1) -> Column:
    f = trailing(w, n)
    std = F.stddev_samp(c).over(f)
    return std if min_rows <= 1 else F.when(F.count(c).over(f) >= min_rows, std)
