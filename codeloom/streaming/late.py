"""Windowed counts that also count what comes too late and what is refused.

Spark's own windowed aggregate drops rows behind the watermark without a trace. Here every window of every group has a
counter of its own, kept by ``transformWithState``, and a timer at the window's end. A row whose window ended
at or before the watermark that stood when its batch began is late; it is counted as such and changes no window that
was given out as closed. Refused rows have a counter that never ends. All of it is in the checkpoint, so a
stream that is stopped and started again goes on with its numbers.

What comes out, in update mode: ``kind, reason, start, n``.

* ``open``: the rows of a window so far; ``closed``: all of them, once its timer has fired
* ``late``: late rows of this batch (a window's late rows are the sum over batches)
* ``reject``: refused rows so far, by what was wrong with them; they have no ``start``
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeloom.session import new_folder
from codeloom.streaming.ingest import update_to

KEYS = ["kind", "reason", "end"]
COUNTED = "kind string, reason string, end bigint, n bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own on the same cluster, with the state store that timers need; the caller's settings stay."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class WindowCounter(StatefulProcessor):
    """The counter of one window, or of one kind of refused rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, reason, end = key
        n = sum(r.n for r in rows)
        if kind == "open" and end <= timerValues.getCurrentWatermarkInMs():
            yield Row(kind="late", reason=reason, end=end, n=n)
            return
        if self.seen.exists():
            n += self.seen.get()[0]
        self.seen.update((n,))
        if kind == "open":
            self.handle.registerTimer(end)
        yield Row(kind=kind, reason=reason, end=end, n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            n = self.seen.get()[0]
            self.seen.clear()
            yield Row(kind="closed", reason=key[1], end=key[2], n=n)

    def close(self) -> None:
        pass


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within each batch, so that a hot window sends a few rows over the shuffle."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(KEYS).aggregate([("n", "sum")]).rename_columns([*KEYS, "n"])
            yield from sums.select([*KEYS, "n"]).to_batches()


def counted_windows(stream: DataFrame, time: str, by: Column, delay: str, length: timedelta, refused: Column | None = None) -> DataFrame:
    """Counts of tumbling windows per group ``by``, of late rows and of refused ones.

    ``refused`` says what is wrong with a row, null if nothing; a row without time is refused as ``no time``. A
    null group is a group. The times of refused rows move the watermark as well. Windows begin at multiples of ``length`` from 1970.
    """
    step = int(length.total_seconds() * 1000)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    ms = F.unix_millis(time)
    wrong = F.when(F.col(time).isNull(), "no time")
    wrong = wrong if refused is None else F.coalesce(wrong, refused)
    rows = timed.select(
        F.when(wrong.isNull(), "open").otherwise("reject").alias("kind"), F.when(wrong.isNull(), by.cast("string")).otherwise(wrong).alias("reason"),
        F.when(wrong.isNull(), ms - F.pmod(ms, F.lit(step)) + step).otherwise(0).cast("bigint").alias("end"), F.lit(1).cast("bigint").alias("n"))
    sums = rows.mapInArrow(_added_up, COUNTED)
    counted = sums.groupBy(*KEYS).transformWithState(WindowCounter(), COUNTED, "Update", "EventTime")
    start = F.when(F.col("kind") != "reject", F.timestamp_millis(F.col("end") - step).cast("timestamp_ntz"))
    return counted.select("kind", "reason", start.alias("start"), "n")


def totals(rows: DataFrame) -> DataFrame:
    """Stored batches (with their ``batch``) to ``kind, reason, start, n``: each window once, ``closed`` or still ``open``, its late rows, refused rows."""
    is_window = F.col("kind").isin("open", "closed")
    last = F.struct("batch", "n", "kind")
    per = rows.groupBy(F.when(is_window, "window").otherwise(F.col("kind")).alias("_what"), "reason", "start").agg(
        F.max(last).alias("_last"), F.sum("n").alias("_sum"))
    return per.select(
        F.when(F.col("_what") == "window", F.col("_last.kind")).otherwise(F.col("_what")).alias("kind"), "reason", "start",
        F.when(F.col("_what") == "late", F.col("_sum")).otherwise(F.col("_last.n")).alias("n"))


class LateCounts:
    """A stream of counted windows over a folder, its state and its output in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str, schema, time: str, by: Column, delay: str, length: timedelta, refused: Column | None = None) -> None:
        self.spark, self.own = spark, stateful_session(spark)
        self.folder, self.schema, self.given = folder, schema, (time, by, delay, length, refused)
        self.out, self.state = new_folder(spark, "late"), new_folder(spark, "late-state")

    def run(self) -> None:
        """Take in all files that are new since the last run."""
        stream = self.own.readStream.schema(self.schema).parquet(self.folder)
        update_to(counted_windows(stream, *self.given), self.out, self.state).awaitTermination()

    def result(self) -> DataFrame:
        return totals(self.spark.read.schema("kind string, reason string, start timestamp_ntz, n bigint, batch bigint").parquet(self.out))
