"""Filter interaction audit: what each of several filters removes, alone, in every order, and on average.

A document becomes a bit mask of the filters it fails, so a part (a source) is a small table: how many
documents have each mask. For a coalition S of filters the removal game is worth v(S), the documents that
fail any filter of S. Its Hart-Mas-Colell potential is P(empty) = 0 and

    P(S) = (v(S) + sum of P(S without i), for i in S) / |S|,

computed recursively from the small coalitions to the large. A filter's Shapley value is P(all) less P(all
but it); times the number of orders it is the number of documents that the filter removes over all orders.
What a filter removes at a step of an order is the difference of two coalitions. Potentials are kept times
the least common multiple of the coalition sizes, so all of it is whole numbers.

The five filters here, on whole texts (null: empty; words are maximal runs of other than ``\\x20 \\x09-\\x0D``):
A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of the code points; D any of
``#$%&*|``; E a text that a row with a smaller id has too, wherever in the table. Rows that repeat the
smallest id of a text are all first; rows without id are neither first nor repeats. A document is good, or toxic,
if any label row of its id says 1; null labels, and labels of other ids, say nothing. A null part is the empty
string. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import small_side
from codeloom.session import persist_table

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
REPEAT = 1 << FILTERS.index("E")


def failed(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    found = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(found)
    fails = (
        n < LEAST_WORDS, 100 * F.size(F.array_distinct(found)) < DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text), text.rlike("[#$%&*|]"),
    )
    mask = F.lit(0)
    for place, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << place).otherwise(0)
    return mask


def _labelled(labels: DataFrame) -> DataFrame:
    yes = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(yes("quality").alias("_good"), yes("toxic").alias("_toxic"))
    return small_side(persist_table(known.where("_good or _toxic"), "labels"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, good, toxic, n``: documents of each part by the filters that they fail.

    Rows come down to one for each text and id before texts are compared; repeats are all less the first
    ones, which are found by text and id together, so a text that fills the table is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failed(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("_text"))
    marked = own.join(_labelled(labels), F.col("_id") == F.col("_labelled"), "left").withColumn("good", F.coalesce("_good", F.lit(False))).withColumn("toxic", F.coalesce("_toxic", F.lit(False)))
    kind = ["part", "mask", "good", "toxic"]
    cells = persist_table(marked.groupBy("_id", "_text", *kind).agg(F.count(F.lit(1)).alias("n")), "cells")
    first = cells.groupBy("_text").agg(F.min("_id").alias("_id")).where("_id is not null")
    kept = cells.join(first, ["_id", "_text"], "left_semi").unionByName(cells.where("_id is null"))
    every = cells.groupBy(*kind).agg(F.sum("n").alias("n"))
    kept = kept.groupBy(*kind).agg(F.sum("n").alias("n"))
    repeat = (F.col("mask") + REPEAT).alias("mask")
    rest = every.select("part", repeat, "good", "toxic", "n").unionByName(kept.select("part", repeat, "good", "toxic", (-F.col("n")).alias("n")))
    return kept.unionByName(rest).groupBy(*kind).agg(F.sum("n").alias("n")).where("n > 0")


def coalitions(counts: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Per part ``removed``, ``good`` and ``toxic``: arrays with the value of each coalition, by its mask."""
    each = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2**filters - 1))))
    out = F.col("mask").bitwiseAND(F.col("s")) != 0
    values = each.groupBy("part", "s").agg(*[
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name) for name, hit in (("removed", out), ("good", out & F.col("good")), ("toxic", out & F.col("toxic")))
    ], F.sum("n").alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("s", "removed", "good", "toxic")))
    rows = values.groupBy("part").agg(ordered.alias("_v"), F.max("size").alias("size"))
    return rows.select("part", "size", *[F.col(f"_v.{name}").alias(name) for name in ("removed", "good", "toxic")])


def potentials(values: Column, filters: int = len(FILTERS)) -> Column:
    """The potential of every coalition, by its mask, times the least common multiple of 1 to ``filters``."""
    scale, bits = math.lcm(*range(1, filters + 1)), F.array(*[F.lit(1 << i) for i in range(filters)])

    def recursion(known: Column, s: Column) -> Column:
        members = F.filter(bits, lambda b: s.bitwiseAND(b) != 0)
        smaller = F.aggregate(members, F.lit(0).cast("long"), lambda total, b: total + F.get(known, s.bitwiseXOR(b)))
        return F.concat(known, F.array(F.call_function("div", scale * F.get(values, s) + smaller, F.size(members))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2**filters - 1)), F.array(F.lit(0).cast("long")), recursion)


def shapley(values: Column, filters: int = len(FILTERS)) -> Column:
    """Per filter, its marginal removals summed over all orders: the grand potential less the one without it."""
    all_, factor = 2**filters - 1, math.factorial(filters) // math.lcm(*range(1, filters + 1))
    return F.array(*[factor * (F.get(values, F.lit(all_)) - F.get(values, F.lit(all_ ^ 1 << i))) for i in range(filters)])


def steps(values: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """Every part, order and step: differences of coalitions (``values`` of :func:`coalitions`)."""
    all_ = 2 ** len(names) - 1
    known = values.withColumn("_potential", potentials(F.col("removed"), len(names))).withColumn("_shapley", shapley(F.col("_potential"), len(names)))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(names)])
    rows = known.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    before, place = F.lit(0), F.lit(0)
    for i, name in enumerate(names):
        at = F.instr("filter_order", name)
        before = before + F.when(at < F.col("step"), 1 << i).otherwise(0)
        place = place + F.when(at == F.col("step"), i).otherwise(0)
    rows = rows.withColumn("_before", before).withColumn("_place", place)
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(names))]), F.col("_place") + 1)
    after = F.col("_before").bitwiseOR(bit)
    gain = lambda name: F.get(name, after) - F.get(name, F.col("_before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("size") - F.get("removed", after)).alias("kept"), gain("removed").alias("removed"),
        (F.get("removed", bit) - gain("removed")).alias("redundant"), (F.get("removed", F.lit(all_)) - F.get("removed", F.lit(all_).bitwiseXOR(bit))).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.get("_shapley", F.col("_place")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return steps(coalitions(masks(docs, labels, id_col, text_col, part_col)))
