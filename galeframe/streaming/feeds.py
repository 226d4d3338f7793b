"""Streaming forms of validation, window statistics and the level filter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from galeframe.config import SITE, TARGET, TS
from galeframe.operators.cleaning import impossible_reasons
from galeframe.operators.kalman import FALLBACK_P0, FALLBACK_Q, FALLBACK_R
from galeframe.operators.validation import gust_below_mean
from galeframe.session import shared_folder

c = F.col


def read_feed(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _event_time(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumns({TS: c(TS).cast("timestamp")}).withWatermark(TS, delay)


def clean_readings(stream: DataFrame, *, delay: str = "6 hours") -> DataFrame:
    """First copy of each (site, hour), rows later than the watermark dropped, with reason code and rule flags."""
    once = _event_time(stream, delay).dropDuplicatesWithinWatermark([SITE, TS])
    out = impossible_reasons(once)
    ok = c(TARGET).isNull() | c(TARGET).between(0.0, 90.09)
    return out.withColumns({"target_in_range": F.coalesce(ok, F.lit(False)), "gust_ok": ~F.coalesce(gust_below_mean(), F.lit(False))})


def window_statistics(stream: DataFrame, value: str, *, width: str = "6 hours", slide: str = "1 hour", delay: str = "6 hours") -> DataFrame:
    """Count, mean and deviation per site over sliding windows; partial sums meet in the state, not the rows."""
    w = F.window(c(TS), width, slide)
    return _event_time(stream, delay).groupBy(SITE, w.alias("_w")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")
    ).select(SITE, c("_w.start").alias("window_start"), c("_w.end").alias("window_end"), "n", "mean", "std")


class LevelFilter(StatefulProcessor):
    """Forward local-level filter of one site, in the order of time whatever the order of arrival.

    The state is the last level and variance, the latest hour seen, and the rows that wait. A row waits until its site has
    shown an hour at least ``delay`` after it; a row that comes when its hour has been passed already is late: it is told
    with no level and does not move the filter.
    """

    def __init__(self, q: float, r: float, p0: float, delay: dt.timedelta) -> None:
        self.q, self.r, self.p0, self.delay = q, r, p0, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        clock = [T.StructField("x", T.DoubleType()), T.StructField("p", T.DoubleType()), T.StructField("latest", T.TimestampType())]
        self.level = handle.getValueState("level", T.StructType(clock))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(TS, T.TimestampType()), T.StructField("bias", T.DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        x, p, latest = self.level.get() if self.level.exists() else (0.0, self.p0, None)
        passed = None if latest is None else pd.Timestamp(latest) - self.delay
        held = [(pd.Timestamp(t), b) for t, b in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for part in rows:
            for t, b in zip(part[TS], part["bias"]):
                if passed is not None and t <= passed:
                    out.append((t, b, None, True))
                else:
                    held.append((t, b))
                    latest = t if latest is None else max(pd.Timestamp(latest), t)
        held.sort(key=lambda r: r[0])
        now = None if latest is None else pd.Timestamp(latest) - self.delay
        ready = sum(1 for t, _ in held if t <= now) if held else 0
        for t, v in held[:ready]:
            p = p + self.q
            if v is not None and v == v:
                gain = p / (p + self.r)
                x, p = x + gain * (v - x), (1.0 - gain) * p
            out.append((t, v, x, False))
        self.level.update((float(x), float(p), None if latest is None else pd.Timestamp(latest).to_pydatetime()))
        if held[ready:]:
            self.waiting.put([(t.to_pydatetime(), None if b is None or b != b else float(b)) for t, b in held[ready:]])
        else:
            self.waiting.clear()
        if out:
            done = pd.DataFrame(out, columns=[TS, "bias", "level", "late"])
            yield pd.DataFrame({SITE: key[0], TS: done[TS], "bias": done["bias"].astype(float), "level": done["level"].astype(float), "late": done["late"].astype(bool)})

    def close(self) -> None:
        pass


def filter_levels(stream: DataFrame, *, delay: dt.timedelta = dt.timedelta(0), q: float = FALLBACK_Q, r: float = FALLBACK_R, p0: float = FALLBACK_P0) -> DataFrame:
    """Filtered level per site and hour, with ``late`` rows told apart; each micro-batch carries on from the stored state.

    A site's clock is its own latest hour, so its rows wait for ``delay`` of its own time and sites do not make each other's
    rows late. A site's task holds its rows of one trigger and those of the last ``delay``; both are bounded by settings.
    The session must keep state in a store for arbitrary state, which ``ordered_state`` sets.
    """
    kinds = ((SITE, T.LongType()), (TS, T.TimestampType()), ("bias", T.DoubleType()), ("level", T.DoubleType()), ("late", T.BooleanType()))
    rows = stream.select(SITE, c(TS).cast("timestamp").alias(TS), "bias").filter(c(TS).isNotNull())
    return rows.groupBy(SITE).transformWithStateInPandas(LevelFilter(q, r, p0, delay), outputStructType=T.StructType([T.StructField(n, t) for n, t in kinds]), outputMode="Append", timeMode="None")


class ordered_state:
    """For the time of a ``with`` block, streams of the session keep their state in the store that ``filter_levels`` needs."""

    NAME, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, self.STORE)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.conf.unset(self.NAME)
        else:
            self.conf.set(self.NAME, self.before)


def replayed(df: DataFrame, batch: str, batches: Sequence[int]) -> DataFrame:
    """A stream that brings the rows of each number of ``batch`` in a trigger of its own, in this order."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    rows = df.drop(batch)
    for n in batches:
        df.filter(c(batch) == n).drop(batch).coalesce(1).write.mode("append").parquet(path)
    return read_feed(spark, path, rows.schema, files_per_batch=1)


def run_available(out: DataFrame, *, keys: list[str] | None = None, told: list[dict] | None = None) -> DataFrame:
    """Run a stream over everything available and return its table.

    Without ``keys`` rows are appended. With ``keys`` updated rows are written
    per batch and the last version of each key is kept. ``told`` receives, for each trigger, the rows in the state and the
    rows that came too late for it.
    """
    def report(query: StreamingQuery) -> None:
        query.awaitTermination()
        if told is not None:
            states = [(p.batchId, p.stateOperators) for p in query.recentProgress]
            told.extend({"batch": n, "in_state": sum(s.numRowsTotal for s in ops), "late": sum(s.numRowsDroppedByWatermark for s in ops)} for n, ops in states)

    spark = out.sparkSession
    home = shared_folder(spark)
    target, state = f"{home}/out", f"{home}/state"
    if keys is None:
        query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        report(query)
        return spark.read.schema(out.schema).parquet(target)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")
    query = out.writeStream.foreachBatch(save).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    report(query)
    rest = [n for n in out.columns if n not in keys]
    versions = spark.read.parquet(target).drop("part")
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *[c("_r")[n].alias(n) for n in rest])
