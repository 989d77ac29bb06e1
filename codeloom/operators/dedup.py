"""First record per key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(df: DataFrame, keys: Sequence[Column], ingest_id: str) -> DataFrame:
    """Keep the record with the lowest ``ingest_id`` per key.

    ``ingest_id`` is unique, so the survivors are found by a combining ``min`` and a semi-join
    on unique ids; a key copied a billion times stays one row per map task.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    firsts = df.select(*named, ingest_id).groupBy(*[f"_k{i}" for i in range(len(named))]).agg(F.min(ingest_id).alias(ingest_id))
    return df.join(firsts.select(ingest_id), ingest_id, "left_semi")


def copies_per_key(df: DataFrame, keys: Sequence[Column], ingest_id: str) -> DataFrame:
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return (
        df.select(*named, ingest_id)
        .groupBy(*[f"_k{i}" for i in range(len(named))])
        .agg(F.min(ingest_id).alias(ingest_id), (F.count(F.lit(1)) - 1).alias("dropped"))
        .select(ingest_id, "dropped")
    )
