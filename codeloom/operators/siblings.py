"""Other methods of the same file, sampled, and calls resolved against them.

The methods of a file stand on a ring in seeded random order. A target takes the ``k`` places
from its own seeded start, so any k distinct places are as likely as any others to be hit,
self included, and each target costs k probes whatever the size of its file. Ring places come
from bucketed positions, so a file holding a third of all methods is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codeloom.operators.ranking import HASH_DIGITS, hash_number, positions, shuffle_key
from codeloom.session import persist_table

SHORT_FILE = 256  # methods of a file that are gathered in one row


def ring(methods: DataFrame, seed: int = 12) -> DataFrame:
    """``file, pid, method, ring, n``: the place of each method and the size of its file."""
    keyed = methods.withColumn("_h", shuffle_key(seed, "pid"))
    return positions(
        keyed, [F.col("_h"), F.col("pid")], F.substring("_h", 1, HASH_DIGITS), keys=["file"], out="ring", total="n"
    ).drop("_h")


def sample_siblings(methods: DataFrame, seed: int = 12, k: int = 10, listed: bool = False) -> DataFrame:
    """``pid, sibling_pid, sibling, id``: up to k methods of the same file, self skipped, ids dense.

    ``listed``: one row for each method that has some, ``pid, siblings`` with an array of the rest. Files of at most ``SHORT_FILE``
    methods are gathered, and a method takes its siblings from the list; larger ones, and all if ids of methods repeat, go by ring places.
    """
    methods = methods.select("file", "pid", "method")
    large = persist_table(methods.where("file is not null").groupBy(F.col("file").alias("_file")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHORT_FILE).select("_file"), "large-files")
    repeated = methods.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or pid is null")
    if repeated.limit(1).count():
        return _listed(_by_places(methods, seed, k)) if listed else _by_places(methods, seed, k)
    same, some = F.col("file") == F.col("_file"), bool(large.limit(1).count())
    out = _by_files(methods.join(large, same, "left_anti") if some else methods, seed, k)
    if some:
        out = out.unionByName(_listed(_by_places(methods.join(large, same, "left_semi"), seed, k)))
    return out if listed else out.select("pid", F.inline("siblings")).select("pid", "sibling_pid", "sibling", "id")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid").agg(F.collect_list(F.struct("sibling_pid", "sibling", "id")).alias("siblings"))


def _by_files(methods: DataFrame, seed: int, k: int) -> DataFrame:
    """Lists of siblings in files that are short: the ring is an array, in the order of its places."""
    place = F.struct(shuffle_key(seed, "pid").alias("h"), "pid", "method")
    rings = methods.where("file is not null").groupBy("file").agg(F.array_sort(F.collect_list(place)).alias("_ring"))
    each = rings.select("_ring", F.explode("_ring").alias("m")).select("_ring", "m.pid", "m.method")
    n = F.size("_ring").cast("bigint")
    start = hash_number(shuffle_key(seed + 1, "pid")) % n
    probes = F.transform(F.sequence(F.lit(0), F.least(F.lit(k).cast("bigint"), n).cast("int") - 1), lambda i: F.get("_ring", ((F.col("_start") + i) % n).cast("int")))
    hits = F.filter(probes, lambda s: s["method"] != F.col("method"))
    found = each.withColumn("_start", start).select("pid", F.transform(hits, lambda s, i: F.struct(s["pid"].alias("sibling_pid"), s["method"].alias("sibling"), i.alias("id"))).alias("siblings"))
    return found.where(F.size("siblings") > 0)


def _by_places(methods: DataFrame, seed: int, k: int) -> DataFrame:
    """Siblings in files of any size, by their places on the ring."""
    placed = ring(methods, seed)
    start = hash_number(shuffle_key(seed + 1, "pid")) % F.col("n")
    probes = placed.select(
        "file", "pid", "method", "n", start.alias("_start"),
        F.explode(F.sequence(F.lit(0), F.least(F.lit(k).cast("bigint"), F.col("n")).cast("int") - 1)).alias("_i"),
    ).select("file", "pid", "method", "_i", ((F.col("_start") + F.col("_i")) % F.col("n")).alias("ring"))
    places = placed.select("file", "ring", F.col("pid").alias("sibling_pid"), F.col("method").alias("sibling"))
    hits = probes.join(places, ["file", "ring"]).where(F.col("sibling") != F.col("method"))
    dense = W.partitionBy("pid").orderBy("_i")
    return hits.select("pid", "sibling_pid", "sibling", (F.row_number().over(dense) - 1).alias("id"))


def resolve_internal(calls: DataFrame, siblings: DataFrame) -> DataFrame:
    """Calls of other methods get ``local_method_<id>``; calls of methods not sampled go. ``siblings``: rows, or lists by method."""
    if "siblings" in siblings.columns:
        met = calls.join(siblings.withColumnRenamed("pid", "_pid"), F.col("pid") == F.col("_pid")).drop("_pid")
        named = met.withColumn("_s", F.explode(F.filter("siblings", lambda s: s["sibling"] == F.col("callee"))))
        return named.select(*calls.columns, F.col("_s.sibling_pid").alias("sibling_pid"), F.concat(F.lit("local_method_"), F.col("_s.id").cast("string")).alias("local_method"))
    named = siblings.select("pid", F.col("sibling").alias("callee"), "sibling_pid", F.col("id").alias("_id"))
    return calls.join(named, ["pid", "callee"]).withColumn(
        "local_method", F.concat(F.lit("local_method_"), F.col("_id").cast("string"))
    ).drop("_id")
