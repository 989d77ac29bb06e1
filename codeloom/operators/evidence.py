"""Evidence of a program: API names, types and keywords, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions.javatypes import api_name, keywords_of_call, types_of_call
from codeloom.functions.text import pad

KINDS = ("apicalls", "types", "keywords")


def api_evidence(apis: DataFrame) -> DataFrame:
    """Adds the three evidence arrays to distinct API strings, so text work is done once each."""
    types = types_of_call(F.col("api"), returns=F.col("returns"))
    return (
        apis.withColumn("apicalls", F.array_compact(F.array(api_name(F.col("api")))))
        .withColumn("types", types)
        .withColumn("keywords", keywords_of_call(F.col("api"), F.col("types")))
    )


MAX_PER_CALL = 1000  # tokens of one kind a single call can give; a place is pos * MAX_PER_CALL + index


def first_places(calls: DataFrame) -> DataFrame:
    """``pid, kind, token, place``: first place of each distinct token of a program (``pid, pos`` and the arrays)."""
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_sort(k).alias("tokens")) for k in KINDS])
    long = (
        calls.select("pid", "pos", F.explode(named).alias("_e"))
        .select("pid", "pos", F.col("_e.kind").alias("kind"), F.posexplode("_e.tokens").alias("idx", "token"))
    )
    return long.groupBy("pid", "kind", "token").agg(F.min(F.col("pos") * MAX_PER_CALL + F.col("idx")).alias("place"))


PLACES_OF_BLOCK = 4096 * MAX_PER_CALL  # places of a program that are cut together


def encoded_sets(places: DataFrame, vocab: DataFrame, width: int = 10, dealt: bool = False) -> DataFrame:
    """One row per program, a fixed-width id array per kind.

    Tokens become ids before anything is ranked, so only numbers are shuffled. A program is cut by blocks of its places; the few
    rows left of it then stand in one partition, where they are ranked and gathered. If places are ``dealt`` by program, and none is
    large, they are gathered where they are.
    """
    coded = places.join(vocab, ["kind", "token"], "left").select("pid", "kind", "place", F.coalesce("id", F.lit(0)).alias("id"))
    if dealt:
        first = lambda k: F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "id")))), 1, width)
        return coded.groupBy("pid").agg(*[_padded(first(k), width).alias(k) for k in KINDS])
    block = F.floor(F.col("place") / PLACES_OF_BLOCK)
    first = W.partitionBy("pid", "kind", "_block").orderBy("place", "id")
    cut = coded.withColumn("_block", block).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= width).drop("_r", "_block").repartition("pid")
    whole = W.partitionBy("pid", "kind").orderBy("place", "id")
    coded = cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= width).select("pid", "kind", "rank", "id")
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "id"))))
    return coded.groupBy("pid").agg(*[_padded(listed(k), width).alias(k) for k in KINDS])


def _padded(ranked: Column, width: int) -> Column:
    return pad(F.transform(ranked, lambda s: s["id"]), width, F.lit(0).cast("bigint"))
