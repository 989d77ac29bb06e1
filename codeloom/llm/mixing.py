"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target of words. Whole epochs of the source come first; the rest of its target is
drawn without replacement: each document has the key -ln(u) / quality, with u from the seed and its id,
and the documents are taken in order of the key while their running size stays within the rest (the one
at the border is taken if that comes nearer). The running sizes come from buckets of the key's logarithm: bucket sums give
each bucket its offset, so only rows of one bucket of one source are sorted together. What is drawn is
then one border per source, a table as long as the list of sources, and the documents themselves are
never shuffled.

Sources stand in code point order, null (a source like any other) last, and take the weights in turn. Targets
share ``share`` times all words by weight, at most ``cap`` times their source's size; what is over is
dealt again by weight. In closed form a target is min(cap * size, level * weight), with the level at
which they add up. Null and empty texts have size 0 and are taken at most ``cap`` times; documents without id are
drawn by their size; rows that share id, key and size are drawn one by one, so many as come nearest to the target. An empty table gives
an empty mix. Further columns are kept by ``repeat_documents`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.llm.common import small_side, uniform
from codeloom.operators.ranking import positions
from codeloom.session import persist_table

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 17
CELLS = 2048  # key buckets for each factor of e: as fine for documents of low quality as for others
SPACE_OUT = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_OUT)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Between 0 and 1; less where symbols are many."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, "!#$%&*|", "")), F.lit(0))
    return (size + F.lit(1.0)) / (size + F.lit(1.0) + symbols)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text, size = F.col(text_col), word_count(F.col(text_col))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))  # "t" stands after every "s..."
    key = -F.ln(uniform(seed, F.col(id_col))) / quality(text, size)
    return [source.alias("_source"), size.alias("_size"), key.alias("_key")]


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``_source, source_size, target`` of each source; one row per source goes through one task."""
    turn = (F.row_number().over(W.orderBy("_source")) - 1) % len(weights) + 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("double"))
    rows = rows.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    by_need = W.orderBy(F.col("_cap") / F.col("_w"), "_source")
    capped = F.coalesce(F.sum("_cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_need.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_level", (F.lit(share) * F.sum("source_size").over(everything) - capped) / open_weight)
    level = F.max("_level").over(everything)  # the level of too many or too few capped sources is lower
    return rows.select("_source", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def _mine() -> Column:
    """A document's place in the order of the draw."""
    return F.struct("_key", F.col("_id").isNotNull().alias("_known"), "_id", "_size")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
         share: float = SHARE, cap: int = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' ids, sizes and keys, and per source its target, whole epochs and the border of the draw.

    ``border`` is the last place that is drawn, ``drawn`` how many of the ``there`` rows that stand at it.
    """
    rows = persist_table(docs.select(F.col(id_col).alias("_id"), *_keyed(docs, id_col, text_col, source_col, seed)), "mix")
    aims = targets(rows.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    aims = persist_table(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    # rows in the same place are one row of the draw, with a count: rows without id, or with one id, may be a third of the table
    places = rows.groupBy("_source", _mine().alias("_mine")).agg(F.count(F.lit(1)).alias("_n"))
    places = places.select("_source", "_mine", "_n", "_mine._size", F.floor(F.lit(CELLS) * F.ln(F.col("_mine._key"))).cast("int").alias("_bucket"))
    sums = places.groupBy("_source", "_bucket").agg(F.sum(F.col("_size") * F.col("_n")).alias("_sum"))
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(aims.select("_source", "rest"), "_source")
    reached = offsets.where("_offset <= rest").drop("_sum")  # later buckets are not drawn from
    inside = W.partitionBy("_source", "_bucket").orderBy("_mine")
    whole = F.col("_size") * F.col("_n")
    before = F.col("_offset") + F.sum(whole).over(inside.rowsBetween(W.unboundedPreceding, 0)) - whole
    # the rows of a place are taken one by one: row i (from 0) if 2 (before + i size) + size <= 2 rest
    fit = F.when(F.col("_size") == 0, F.col("_n")).otherwise(F.least(F.col("_n"), F.floor((2 * F.col("rest") - 2 * F.col("_before") + F.col("_size")) / (2 * F.col("_size"))).cast("long")))
    drawn = places.join(reached, ["_source", "_bucket"]).withColumn("_before", before).where(2 * F.col("_before") + F.col("_size") <= 2 * F.col("rest"))
    last = drawn.groupBy("_source").agg(F.max(F.struct("_mine", fit.alias("drawn"), F.col("_n").alias("there"))).alias("_last"))
    last = last.select("_source", F.col("_last._mine").alias("border"), F.col("_last.drawn").alias("drawn"), F.col("_last.there").alias("there"))
    return rows, persist_table(aims.join(last, "_source", "left").withColumn("cap", F.lit(cap)), "aims")


def _with_copies(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """Rows (``_source, _key, _id, _size``) with ``copies``; of rows at a border only partly drawn, the first in the table."""
    joined = rows.join(small_side(aims.drop("rest")), "_source")
    at_border = F.coalesce(_mine() == F.col("border"), F.lit(False))
    taken = F.coalesce(_mine() <= F.col("border"), F.lit(False)).cast("int")
    copies = lambda extra: F.least(F.col("epochs") + extra, F.col("cap")).alias("copies")
    keep = [*rows.columns, "source_size", "target"]
    if not aims.where("drawn < there").limit(1).count():
        return joined.select(*keep, copies(taken))
    partly = at_border & (F.col("drawn") < F.col("there"))
    row = F.monotonically_increasing_id()
    tied = positions(joined.where(partly).withColumn("_row", row), [F.col("_row")], F.shiftright("_row", 12), ["_source"], out="_tie")
    return joined.where(~partly).select(*keep, copies(taken)).unionByName(tied.select(*keep, copies((F.col("_tie") < F.col("drawn")).cast("int"))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, copies``."""
    rows, aims = plan(docs, **options)
    rows = _with_copies(rows, aims)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    _, aims = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    rows = docs.select(F.struct("*").alias("_whole"), F.col(id_col).alias("_id"), *_keyed(docs, id_col, text_col, source_col, seed))
    rows = _with_copies(rows, aims).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")
