"""Row positions without a single-task sort.

A plain ``row_number()`` over a whole table, or over one hot group, sorts everything in one
task. Here rows are first put in an order-preserving bucket (an md5 prefix, an id range, an
hour); bucket counts give each bucket its offset, and only rows within a bucket are sorted. The counts
themselves are added up in two levels, so no task reads a number of rows that grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from codeloom.session import persist_table

HASH_DIGITS = 3  # 16**3 buckets


def shuffle_key(seed: int | str, *cols: str) -> Column:
    """Seeded random order that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_number(key: Column) -> Column:
    """First 32 bits of an md5 hex string as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash01(key: Column) -> Column:
    return hash_number(key) / F.lit(float(16**8))


def _cell(keys: Sequence[str], bucket: Column) -> Column:
    """Group and bucket as one struct: never null itself, so rows with nulls inside still meet their offset."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b"))


def _group(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*[f"_bucket.k{i}" for i in range(len(keys))])


def _before(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``cells`` (``_bucket`` and ``value``) with ``_offset``, the sum of the buckets before, and ``_all``, that of the group.

    Without keys the buckets are one group that may be large. They are dealt to ranges, cut at sampled
    quantiles; each range is summed up by itself, and what stands before a range comes from one row per range, whose
    number is that of the shuffle partitions, however many buckets there are.
    """
    if keys:
        group = _group(keys)
        before = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        return cells.withColumn("_offset", F.coalesce(F.sum(value).over(before), F.lit(0))).withColumn("_all", F.sum(value).over(group))
    ranges = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = persist_table(persist_table(cells, "cells").repartitionByRange(ranges, "_bucket").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    one = W.orderBy("_range")  # one row for each range
    sums = sums.select(
        F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(one.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    inside = W.partitionBy("_range").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = own.join(F.broadcast(sums), F.col("_range") == F.col("_at"))
    return joined.select("_bucket", value, (F.col("_base") + F.col("_inside")).alias("_offset"), "_all")


def positions(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    keys: Sequence[str] = (),
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group (the whole table if there are no keys).

    ``bucket`` must rise with ``order``. The offsets table has one row per (group, bucket).
    Rows whose key is null are a group of their own; a null order value comes first.
    """
    rows = df.withColumn("_bucket", _cell(keys, bucket))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(counts, keys, "_n")
    offsets = offsets.withColumnRenamed("_all", total) if total else offsets.drop("_all")
    inside = W.partitionBy("_bucket").orderBy(*order)
    return (
        rows.join(offsets.drop("_n"), "_bucket")
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    bucket: Column,
    keys: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum in order, bucketed the same way as :func:`positions`."""
    rows = df.withColumn("_bucket", _cell(keys, bucket)).withColumn("_v", value)
    sums = rows.groupBy("_bucket").agg(F.sum("_v").alias("_s"))
    offsets = _before(sums, keys, "_s").drop("_all")
    inside = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(offsets.drop("_s"), "_bucket")
        .withColumn(out, F.col("_offset") + F.sum("_v").over(inside))
        .drop("_bucket", "_offset", "_v")
    )


def shuffled(df: DataFrame, seed: int, id_col: str, out: str = "pos", total: str | None = None) -> DataFrame:
    """Position of every row in a seeded random order."""
    key = shuffle_key(seed, id_col)
    return positions(
        df.withColumn("_h", key),
        [F.col("_h"), F.col(id_col)],
        F.substring("_h", 1, HASH_DIGITS),
        out=out,
        total=total,
    ).drop("_h")


def whole_batches(df: DataFrame, batch_size: int, seed: int, id_col: str, max_batches: int | None = None) -> DataFrame:
    """Shuffle, number, cut to whole batches; ``batch_id`` says which batch a row feeds."""
    ranked = shuffled(df, seed, id_col, out="pos", total="_total")
    batches = F.floor(F.col("_total") / batch_size)
    if max_batches is not None:
        batches = F.least(batches, F.lit(max_batches).cast("bigint"))
    return (
        ranked.where(F.col("pos") < batches * batch_size)
        .withColumn("batch_id", F.floor(F.col("pos") / batch_size))
        .drop("_total")
    )


def equal_chunks(df: DataFrame, chunks: int, order_col: str, bucket: Column, out: str = "chunk") -> DataFrame:
    """Contiguous chunks whose sizes differ by at most one, larger ones first."""
    ranked = positions(df, [F.col(order_col)], bucket, out="_pos", total="_total")
    small = F.floor(F.col("_total") / chunks)
    extra = F.col("_total") % chunks
    edge = extra * (small + 1)
    chunk = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(
        extra + F.floor((F.col("_pos") - edge) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn(out, chunk.cast("int")).drop("_pos", "_total")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: Column, out: str = "rank") -> DataFrame:
    """Best k rows per group in two rounds: per salt first, so a hot group is never in one task."""
    spread = df.withColumn("_salt", salt)
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    cut = spread.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r", "_salt")
    return cut.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
