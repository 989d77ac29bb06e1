"""All call sequences a program can make, built from the innermost lists outwards.

A statement list has a set of ways through it. A plain statement has one way, its calls; a control node's ways
are put together from those of its lists: a branch takes its condition and then one side or the other, a loop
its condition, body and condition, a try block its body and then perhaps the catch. Ways are rows. A list is contracted
by joining neighbours, (0, 1), (2, 3) and so on, until one place is left, so it takes the logarithm of its length in
joins; ways that become equal become one row at once. How many ways a list can have at most, and how long the longest is,
follows from counts per statement before anything is joined: programs past a limit are reported with that
number and leave, all others are whole. Programs that are short, and of which counts say that their ways are few, are read
through one by one instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.operators import scope as sc
from codeloom.operators.trees import BATCH_ROWS, CONTROL, entered_controls, in_order, programs_in
from codeloom.session import persist_buckets, persist_table

MOST, LONGEST = 1 << 16, 1 << 16  # ways of a program, calls of a way
FEW = 1 << 20  # calls in all ways together of a program that is read through by itself
LIST = ["pid", "owner", "slot"]
TOO_MANY, TOO_LONG = "too many sequences", "too long a sequence"


def _statements(nodes: DataFrame) -> DataFrame:
    """``pid, node_id, owner, slot, pos, depth, tag, calls, times``: nodes in the lists of control nodes and of the body.

    ``times``: how often a way can come by, as a loop's condition comes twice.
    """
    inside = F.col("depth") == F.size(entered_controls(F.col("scope")))
    calls = F.transform(F.coalesce("calls", F.slice("calls", 1, 0)), lambda c: c["call"])
    return nodes.where(inside & F.col("pid").isNotNull()).select(
        "pid", "node_id", F.col("parent_id").alias("owner"), "slot", F.col("slot_pos").alias("pos"), "depth", "tag",
        F.when(F.col("tag").isin(*CONTROL), None).otherwise(F.coalesce(calls, F.array().cast("array<string>"))).alias("calls"),
        F.pow(F.lit(2.0), F.size(F.filter(entered_controls(F.col("scope")), lambda c: c["in_slot"] == "_cond"))).alias("times"),
    )


def _limits(items: DataFrame, most: int, longest: int) -> DataFrame:
    """``pid, rejected, ways``: programs with a list that can have more than ``most`` ways, or one longer than ``longest``."""
    each = items.groupBy(*LIST, "pos").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("seq")).alias("len"))
    whole = each.groupBy(*LIST).agg(F.sum(F.log2("n")).alias("bits"), F.sum("len").alias("len"))
    many, long = F.round("bits", 6) > F.log2(F.lit(float(most))), F.col("len") > longest
    over = whole.where(many | long).groupBy("pid").agg(F.max("bits").alias("bits"), F.bool_or(many).alias("many"))
    return over.select("pid", F.when(F.col("many"), TOO_MANY).otherwise(TOO_LONG).alias("rejected"), F.pow(F.lit(2.0), "bits").alias("ways"))


def _contracted(items: DataFrame, length: int) -> DataFrame:
    """The ways through each list: ``pid, owner, slot, seq``; ``length`` is that of the longest list."""
    while length > 1:
        pair = F.floor(F.col("pos") / 2).cast("int")
        left = items.where("pos % 2 = 0").select(*LIST, pair.alias("pos"), "seq")
        right = items.where("pos % 2 = 1").select(*LIST, pair.alias("pos"), F.col("seq").alias("then"))
        both = left.join(right, [*LIST, "pos"], "full")  # a list may have gaps, where something stood that is no node
        joined = F.when(F.col("then").isNull(), F.col("seq")).when(F.col("seq").isNull(), F.col("then")).otherwise(F.concat("seq", "then"))
        items = persist_table(both.select(*LIST, "pos", joined.alias("seq")).distinct(), "ways")
        length = -(-length // 2)
    return items.select(*LIST, "seq")


def _control_ways(controls: DataFrame, lists: DataFrame) -> DataFrame:
    """Ways of control nodes as items of the lists they stand in."""
    own = controls.select("pid", "node_id", "owner", "slot", "pos", "tag")
    nothing = F.array().cast("array<string>")

    def ways(slot: str, name: str) -> DataFrame:
        return lists.where(F.col("slot") == slot).select(F.col("pid").alias("_pid"), F.col("owner").alias("_of"), F.col("seq").alias(name))

    def then(rows: DataFrame, slot: str) -> DataFrame:
        """Rows with each way of a slot put after their own; an empty slot has one way, of no calls."""
        more = ways(slot, "_next")
        joined = rows.join(more, (F.col("pid") == F.col("_pid")) & (F.col("node_id") == F.col("_of")), "left")
        return joined.select("pid", "node_id", "owner", "slot", "pos", F.concat("seq", F.coalesce("_next", nothing)).alias("seq"))

    start = own.withColumn("seq", nothing)
    guarded = then(start.where("tag = 'DBranch'"), "_cond")
    branches = then(guarded, "_then").unionByName(then(guarded, "_else"))
    loops = then(then(then(start.where("tag = 'DLoop'"), "_cond"), "_body"), "_cond")
    tried = then(start.where("tag = 'DExcept'"), "_try")
    return branches.unionByName(loops).unionByName(tried).unionByName(then(tried, "_catch")).select(*LIST, "pos", "seq").distinct()


def _large(rows: DataFrame, most: int, longest: int) -> DataFrame:
    """``_large``: programs that are long, or of which bounds by counts say that they can have many ways or long ones."""
    forks = F.coalesce(F.sum(F.when(F.col("tag").isin("DBranch", "DExcept"), F.col("times"))), F.lit(0.0))
    calls = F.coalesce(F.sum(F.when(F.col("calls").isNotNull(), F.col("times") * F.size("calls"))), F.lit(0.0))
    sizes = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), forks.alias("forks"), calls.alias("called"))
    many = (F.col("forks") > F.log2(F.lit(float(most)))) | (F.col("called") > longest) | (F.pow(F.lit(2.0), "forks") * F.col("called") > FEW)
    return sizes.where(many | (F.col("n") > sc.SHORT)).select(F.col("pid").alias("_large"))


def _ways_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []

    def made() -> pa.RecordBatch:
        calls = [way for _, way in out]
        ends = [0]
        for way in calls:
            ends.append(ends[-1] + len(way))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([c for way in calls for c in way], pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([pid for pid, _ in out], pa.int64()), listed], names=["pid", "calls"])

    for rows in programs_in(batches):
        out.extend((rows[0][0], way) for way in _ways_through(rows))
        if len(out) >= BATCH_ROWS:
            yield made()
            out = []
    if out:
        yield made()


def _ways_through(rows: list[tuple]) -> set[tuple]:
    """All ways through one program, from its innermost lists outwards: a node comes before all that is in it."""
    items: dict = {}  # by list, last statement first

    def ways(owner: int, slot: str) -> set[tuple]:
        done = {()}
        for item in reversed(items.get((owner, slot), ())):
            done = {a + b for a in done for b in item}
        return done

    then = lambda before, after: {a + b for a in before for b in after}
    for _, node_id, owner, slot, tag, calls in reversed(rows):
        if tag == "DBranch":
            own = then(ways(node_id, "_cond"), ways(node_id, "_then") | ways(node_id, "_else"))
        elif tag == "DLoop":
            guard = ways(node_id, "_cond")
            own = then(then(guard, ways(node_id, "_body")), guard)
        elif tag == "DExcept":
            tried = ways(node_id, "_try")
            own = tried | then(tried, ways(node_id, "_catch"))
        else:
            own = {tuple(calls)}
        items.setdefault((owner, slot), []).append(own)
    return ways(-1, "_nodes")


def call_sequences(nodes: DataFrame, most: int = MOST, longest: int = LONGEST, buckets: int = 0) -> DataFrame:
    """``pid, calls, rejected, ways``: every way through a program; one row with a reason, and how many ways there can be, past a limit.

    ``buckets``: to how many the nodes are dealt by program, if they are.
    """
    rows = persist_buckets(_statements(nodes), "statements", "pid", buckets)
    large = persist_table(_large(rows, most, longest), "large")
    same = F.col("pid") == F.col("_large")
    some = bool(large.limit(1).count())
    short = rows.join(large, same, "left_anti") if some else rows
    listed = short.withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    found = in_order(listed, "pid", "node_id", "owner", "slot", "tag", "calls").mapInArrow(_ways_batches, "pid bigint, calls array<string>")
    whole = found.select("pid", "calls", F.lit(None).cast("string").alias("rejected"), F.lit(None).cast("double").alias("ways"))
    return whole.unionByName(_by_joins(persist_table(rows.join(large, same, "left_semi"), "long-statements"), most, longest)) if some else whole


def _by_joins(rows: DataFrame, most: int, longest: int) -> DataFrame:
    """Of programs of any size; ``rows`` are stored."""
    size = {r["depth"]: r["n"] for r in rows.groupBy("depth").agg((F.max("pos") + 1).alias("n")).collect()}  # one row per level of nesting
    lists = rejected = None
    for depth in sorted(size, reverse=True):
        here = rows.where(F.col("depth") == depth)
        items = here.where("calls is not null").select(*LIST, "pos", F.col("calls").alias("seq"))
        controls = here.where("calls is null")
        if lists is None:
            lists = items.select(*LIST, "seq").limit(0)
        items = persist_table(items.unionByName(_control_ways(controls, lists)), "items")
        over = persist_table(_limits(items, most, longest), "over")
        rejected = over if rejected is None else rejected.unionByName(over)
        gone = rejected.select("pid").distinct()
        lists = _contracted(items.join(gone, "pid", "left_anti"), size[depth])
    if rejected is None:
        return rows.select("pid", "calls", F.lit(None).cast("string").alias("rejected"), F.lit(None).cast("double").alias("ways"))
    out = rejected.groupBy("pid").agg(F.max_by("rejected", "ways").alias("rejected"), F.max("ways").alias("ways"))
    done = lists.where("owner = -1").join(out.select("pid"), "pid", "left_anti")
    empty = F.lit(None).cast("array<string>")
    return done.select("pid", F.col("seq").alias("calls"), F.lit(None).cast("string").alias("rejected"), F.lit(None).cast("double").alias("ways")).unionByName(
        out.select("pid", empty.alias("calls"), "rejected", "ways"))
