"""Clusters of vectors and how alike the sets of their members are."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from codeloom.operators.ranking import top_k

MEMBERS = 201  # a cluster keeps growing while it has at most 200 members


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 12) -> DataFrame:
    data = vectors.withColumn("_v", array_to_vector("vector"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v")


def two_dimensional(vectors: DataFrame) -> DataFrame:
    data = vectors.withColumn("_v", array_to_vector("vector"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(data)
    xy = vector_to_array("_p")
    return model.transform(data).withColumn("x", F.get(xy, F.lit(0))).withColumn("y", F.get(xy, F.lit(1))).drop("_v", "_p")


def cap_members(members: DataFrame, cap: int = MEMBERS, key: str = "cluster", member: str = "id") -> DataFrame:
    salt = F.pmod(F.xxhash64(member), F.lit(256))
    return top_k(members, [key], [F.col(member)], cap, salt).drop("rank")


def mean_jaccard(members: DataFrame, cap: int = MEMBERS) -> DataFrame:
    """``i, j, avg`` for i <= j over ``cluster, id, items`` (distinct items).

    The member cap is part of the measure and bounds the pairs. Equal sets of a cluster are
    first merged with their count; then only sets that share an item meet. All other pairs are
    disjoint and add 0, except two empty sets, which add 1.
    """
    kept = cap_members(members, cap)
    sets = kept.withColumn("items", F.array_sort("items")).groupBy("cluster", "items").agg(F.count(F.lit(1)).alias("w"))
    sets = sets.withColumn("set_id", F.xxhash64("cluster", "items")).withColumn("size", F.size("items"))
    items = sets.select("cluster", "set_id", "size", "w", F.explode("items").alias("item"))
    a, b = items.alias("a"), items.alias("b")
    met = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.cluster") <= F.col("b.cluster")))
    met = met.where((F.col("a.cluster") < F.col("b.cluster")) | (F.col("a.set_id") < F.col("b.set_id")))
    shared = met.groupBy(
        F.col("a.cluster").alias("i"), F.col("b.cluster").alias("j"), F.col("a.set_id").alias("sa"), F.col("b.set_id").alias("sb")
    ).agg(
        F.count(F.lit(1)).alias("common"), F.first("a.size").alias("na"), F.first("b.size").alias("nb"),
        F.first(F.col("a.w") * F.col("b.w")).alias("w"),
    )
    across = shared.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("s"))
    # pairs of equal sets inside a cluster count 1 each, empty or not
    twins = sets.groupBy(F.col("cluster").alias("i")).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("s"))
    twins = twins.select("i", F.col("i").alias("j"), "s")
    totals = sets.groupBy("cluster").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("size") == 0, F.col("w")).otherwise(0)).alias("empty"))
    left = totals.select(F.col("cluster").alias("i"), F.col("n").alias("ni"), F.col("empty").alias("ei"))
    right = totals.select(F.col("cluster").alias("j"), F.col("n").alias("nj"), F.col("empty").alias("ej"))
    # one row per cluster on each side: k (k + 1) / 2 cells of the result itself
    cells = left.join(right, F.col("i") <= F.col("j"))
    sums = across.unionByName(twins).groupBy("i", "j").agg(F.sum("s").alias("s"))
    whole = cells.join(sums, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    inside = F.col("s") / (0.001 + F.col("ni") * (F.col("ni") - 1) / 2)
    between = (F.col("s") + F.col("ei") * F.col("ej")) / (F.col("ni") * F.col("nj") + 0.0001)
    return whole.select("i", "j", F.when(F.col("i") == F.col("j"), inside).otherwise(between).alias("avg"))


def matrix(averages: DataFrame) -> DataFrame:
    """Square form, ``i, j, avg`` for every two clusters that the data have: the upper half mirrored."""
    return averages.unionByName(averages.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "avg"))


def matrix_lines(averages: DataFrame, digits: int = 3) -> DataFrame:
    """``i, line``: a row of the square form as text, in order of the other cluster."""
    cells = F.array_sort(F.collect_list(F.struct("j", "avg")))
    shown = F.transform(cells, lambda c: F.format_string(f"%.{digits}f", F.round(c["avg"], digits)))
    return matrix(averages).groupBy("i").agg(F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("line"))


def by_cohesion(averages: DataFrame) -> DataFrame:
    return averages.where("i = j").select(F.col("i").alias("cluster"), "avg").orderBy(F.desc("avg"), "cluster")
