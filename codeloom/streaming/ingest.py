"""Programs and events as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from codeloom.session import new_folder


def watch_programs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON-lines files of a folder."""
    return spark.readStream.schema(schema).option("ignoreCorruptFiles", True).json(folder)


def watch_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table file or folder as a stream."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    path = os.path.join(sf_dir, f"{name}.parquet")
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def without_repeats(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """First record per key; keys are forgotten once the watermark has passed them."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: Column, delay: str, length: str, slide: str | None = None) -> DataFrame:
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = _timed(stream, time).withWatermark(time, delay).groupBy(window.alias("w"), by.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "reason", "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of each batch under its number; a repeated batch replaces its folder."""

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_append(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = new_folder(spark, name)
    append_to(stream, path, new_folder(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Latest row per key after all available input."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    update_to(stream, path, new_folder(spark, f"{name}-state")).awaitTermination()
    rows = spark.read.parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


class Progress(StreamingQueryListener):
    """Counts input rows and reports whenever another ``step`` of them has passed."""

    def __init__(self, step: int = 1000, report=print):
        self.step, self.report, self.seen, self.told = step, report, 0, 0

    def onQueryStarted(self, event):
        self.report(f"started {event.id}")

    def onQueryProgress(self, event):
        self.seen += event.progress.numInputRows
        if self.seen // self.step > self.told:
            self.told = self.seen // self.step
            self.report(f"records processed: {self.seen}")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.report(f"ended after {self.seen} records")
