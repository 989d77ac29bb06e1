"""Batches of several epochs on disk, read from any batch on.

Every epoch has its own seeded order. Batches lie in shards of ``PER_SHARD``, in folders by epoch and shard, so
that a reader who starts in the middle opens only what is left. Readers keep their place under a name, and rows go to
tasks, never through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators.ranking import whole_batches

PER_SHARD = 64
OWN = ("epoch", "shard", "batch_id", "pos")


def write_epochs(rows: DataFrame, path: str, epochs: int, batch_size: int, seed: int, id_col: str, most: int | None = None) -> None:
    """Whole batches of each epoch (rows that fill none are left out, others in each epoch), at most ``most`` of them.

    Rows that repeat an id keep places beside each other. Too few rows for one batch are an error, and so are columns named like ours.
    """
    clash = sorted(set(OWN) & set(rows.columns))
    if clash:
        raise ValueError(f"columns {clash} are taken")
    batches = rows.count() // batch_size
    batches = batches if most is None else min(batches, most)
    if epochs < 1 or batches < 1:
        raise ValueError("not one whole batch")
    each = [whole_batches(rows, batch_size, seed + e, id_col, most).withColumn("epoch", F.lit(e)) for e in range(epochs)]
    dealt = reduce(DataFrame.unionByName, each).withColumn("shard", F.floor(F.col("batch_id") / PER_SHARD).cast("int"))
    order = ["epoch", "shard", "batch_id", "pos"]
    dealt.repartition("epoch", "shard").sortWithinPartitions(*order).write.partitionBy("epoch", "shard").parquet(f"{path}/rows")
    sizes = rows.sparkSession.range(1).select(F.lit(epochs).alias("epochs"), F.lit(batches).cast("bigint").alias("batches"), F.lit(batch_size).alias("batch_size"))
    sizes.write.parquet(f"{path}/sizes")  # comes last: without it there is nothing to read


class EpochFeed:
    """Reads what :func:`write_epochs` wrote. A place is (epoch, batch)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.epochs, self.batches, self.batch_size = spark.read.parquet(f"{path}/sizes").select("epochs", "batches", "batch_size").first()

    def after(self, place: tuple[int, int], batches: int) -> tuple[int, int]:
        """The place so many batches on; (epochs, 0) is the end."""
        at = min(place[0] * self.batches + place[1] + batches, self.epochs * self.batches)
        return divmod(at, self.batches)

    def rows(self, start: tuple[int, int] = (0, 0), batches: int | None = None) -> DataFrame:
        """Rows of ``batches`` batches from a place on, to the end if none are named. Whole shards before and after are not opened."""
        (e0, b0), (e1, b1) = start, self.after(start, self.epochs * self.batches if batches is None else batches)
        epoch, batch, shard = F.col("epoch"), F.col("batch_id"), F.col("shard")
        from_here = (epoch > e0) | ((epoch == e0) & (shard >= b0 // PER_SHARD) & (batch >= b0))
        to_there = (epoch < e1) | ((epoch == e1) & (shard <= b1 // PER_SHARD) & (batch < b1))
        return self.spark.read.parquet(f"{self.path}/rows").where(from_here & to_there)

    def each(self, use: Callable[[pd.DataFrame], pd.DataFrame], schema: str, start: tuple[int, int] = (0, 0), batches: int | None = None) -> DataFrame:
        """What ``use`` makes of every batch, whose rows it gets in order. A batch has a fixed size."""

        def ordered(batch: pd.DataFrame) -> pd.DataFrame:
            return use(batch.sort_values("pos", ignore_index=True))

        return self.rows(start, batches).groupBy("epoch", "batch_id").applyInPandas(ordered, schema)

    def keep_place(self, reader: str, place: tuple[int, int]) -> None:
        """All before ``place`` is done. Places of a reader are added, the furthest counts."""
        one = self.spark.range(1).select(F.lit(place[0]).cast("bigint").alias("epoch"), F.lit(place[1]).cast("bigint").alias("batch"))
        one.write.mode("append").parquet(f"{self.path}/places/{reader}")

    def place(self, reader: str) -> tuple[int, int]:
        """Where a reader goes on; for one that has kept a place before."""
        last = self.spark.read.schema("epoch bigint, batch bigint").parquet(f"{self.path}/places/{reader}").agg(F.max(F.struct("epoch", "batch")).alias("p")).first()["p"]
        return last["epoch"], last["batch"]
