"""What the text operators share: tables, Arrow batches, memory of the Python workers."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galeframe.operators.settle import settle
from galeframe.session import prepare

#: Rows of a batch sent to Python, so that long texts do not add up in a worker.
BATCH_ROWS = 2_000
stash = settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def settled_keys(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table of keys (a few numbers a row), broadcast up to ``most`` rows; beyond them the join shuffles."""
    keys = stash(keys)
    return F.broadcast(keys) if keys.count() <= most else keys


def release_memory() -> None:
    """Give freed memory back to the system, at the end of a task at least: Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so later tasks find what earlier ones put there."""
    module = sys.modules.setdefault("_galeframe_worker_store", types.ModuleType("_galeframe_worker_store"))
    return module.__dict__.setdefault(name, {})


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function that yields dictionaries of equally long columns."""
    small_batches(df.sparkSession)
    want = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, cols[f.name]) for f in want)], schema=want)
        release_memory()
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(size[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
