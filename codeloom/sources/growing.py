"""Stores that grow: vocabularies and relations whose rows, once given out, never change.

A store is a folder. Version n adds ``rows/version=n``, the rows that were not there before, and then
``versions/version=n``, one small row that makes them count. Readers take rows up to a version, the newest one that
counts if none is named, so a merge that is under way or was broken off is never seen; the next merge writes its folder
anew. An encoded corpus can be read years later with the version that it was written with. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codeloom.operators.ranking import positions
from codeloom.session import persist_table


class GrowingStore:
    """``keys`` name a row; with ``numbered`` each has an ``id``, from 1 in every ``group`` and in order of arrival (0 is for unknown rows)."""

    def __init__(self, spark: SparkSession, path: str, keys: str, numbered: bool = False, group: str | None = None) -> None:
        self.spark, self.path, self.numbered, self.group = spark, path, numbered, group
        self.fields = T.StructType.fromDDL(keys)
        self.keys = self.fields.fieldNames()
        if group is not None and group not in self.keys:
            raise ValueError(f"{group} is none of the keys {self.keys}")

    def _schema(self) -> T.StructType:
        full = T.StructType(list(self.fields.fields))
        return full.add("id", T.LongType()) if self.numbered else full

    def create(self) -> GrowingStore:
        """An empty store, as version 0. A folder that holds one already is an error."""
        self._publish(self.spark.createDataFrame([], self._schema()), 0)
        return self

    def _publish(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        one = self.spark.range(1).select(F.current_timestamp().alias("at"))
        one.write.mode("errorifexists").parquet(f"{self.path}/versions/version={version}")

    def latest(self) -> int:
        known = self.spark.read.schema("at timestamp, version bigint").parquet(f"{self.path}/versions")
        return known.agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """``keys…``, ``id`` if there is one, and ``version``, the one that brought the row."""
        newest = self.latest()
        if version is not None and not 0 <= version <= newest:
            raise ValueError(f"version {version} of a store that has 0 to {newest}")
        full = self._schema().add("version", T.LongType())
        return self.spark.read.schema(full).parquet(f"{self.path}/rows").where(F.col("version") <= (newest if version is None else version))

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def merge(self, rows: DataFrame, order: Sequence[str] = (), bucket: Column | None = None) -> int:
        """Add what is not there yet, as a new version, and give its number.

        New rows are numbered by their first ``order`` values and then their keys; ``bucket`` must rise with ``order`` and
        may use its columns. Only distinct keys meet the store, and only new ones are numbered.
        """
        order, now = list(order), self.latest()
        if order:
            first = rows.groupBy(*self.keys).agg(F.min(F.struct(*order)).alias("_first"))
        else:
            first = rows.select(*self.keys).distinct()
        stored = self.read(now)
        new = first.join(stored, self._same(first, stored), "left_anti")
        if self.numbered:
            if not order or bucket is None:
                raise ValueError("a numbered store needs an order and a bucket")
            new = persist_table(new.select(*self.keys, "_first.*"), "new")
            by = [self.group] if self.group else []
            placed = positions(new, [*[F.col(c) for c in order], *[F.col(k) for k in self.keys]], bucket, keys=by, out="_place")
            if self.group:
                tops = stored.groupBy(F.col(self.group).alias("_group")).agg(F.max("id").alias("_top"))
                placed = placed.join(tops, placed[self.group].eqNullSafe(tops["_group"]), "left")
            else:
                placed = placed.withColumn("_top", F.lit(stored.agg(F.max("id")).first()[0]).cast("bigint"))
            new = placed.withColumn("id", F.coalesce("_top", F.lit(0)) + F.col("_place") + 1)
        self._publish(new.select(*self._schema().fieldNames()), now + 1)
        return now + 1

    def encode(self, rows: DataFrame, infer: bool = True, order: Sequence[str] = (), bucket: Column | None = None, version: int | None = None) -> DataFrame:
        """``rows`` with ``id``. When inferring, the store stays as it is and unknown rows get 0; else they are merged first.

        ``rows`` is read twice when merging. ``version`` pins the vocabulary that is inferred with.
        """
        if not self.numbered:
            raise ValueError("rows of this store have no ids")
        if not infer:
            if version is not None:
                raise ValueError("a pinned version does not grow")
            version = self.merge(rows, order, bucket)
        known = self.read(version).drop("version")
        joined = rows.join(known, self._same(rows, known), "left")
        return joined.select(*[rows[c] for c in rows.columns], F.coalesce(known["id"], F.lit(0)).alias("id"))
