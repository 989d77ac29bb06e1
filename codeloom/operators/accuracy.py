"""Hit rates of scored steps by category and by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codeloom.operators.ranking import running_sum


def by_category(steps: DataFrame, concept: str) -> DataFrame:
    """``category, hits, n, accuracy`` with the two totals ``all`` and ``all_but_concept``."""
    per = steps.groupBy("category").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    labels = F.when(F.col("category") == concept, F.array("category", F.lit("all"))).otherwise(
        F.array("category", F.lit("all"), F.lit("all_but_concept"))
    )
    spread = per.select(F.explode(labels).alias("category"), "hits", "n")
    return spread.groupBy("category").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).withColumn(
        "accuracy", F.col("hits") / F.col("n")
    )


def by_position(steps: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``pos, n, hits, prob_mass`` and the two shares; excluded categories do not count."""
    kept = steps.where(~F.col("category").isin(*exclude)) if exclude else steps
    per = kept.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("prob")).otherwise(0)).alias("prob_mass")
    )
    return per.withColumn("hit_share", F.col("hits") / F.col("n")).withColumn("prob_share", F.col("prob_mass") / F.col("n"))


def cumulative_log(positions: DataFrame, share: str = "hit_share") -> DataFrame:
    """Running sum of ``ln(p + 1e-5)`` by position, positions without a number left out."""
    usable = positions.where(F.col(share).isNotNull() & ~F.isnan(share) & (F.abs(share) < float("inf")))
    return running_sum(usable, F.ln(F.col(share) + 0.00001), [F.col("pos")], F.floor(F.col("pos") / 1024), out="cum_log")


def horizon(steps: DataFrame, concept: str) -> DataFrame:
    """``category, length, n, prob_sum`` per category and for the two roll-ups."""
    per = steps.groupBy("category", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("max_prob").alias("prob_sum"))
    labels = F.when(F.col("category") == concept, F.array("category", F.lit("all"))).otherwise(
        F.array("category", F.lit("all"), F.lit("all_but_concept"))
    )
    spread = per.select(F.explode(labels).alias("category"), "length", "n", "prob_sum")
    return spread.groupBy("category", "length").agg(F.sum("n").alias("n"), F.sum("prob_sum").alias("prob_sum"))
