"""Reply trees as training conversations: root-to-leaf paths, ranked by score, formatted with a loss mask.

Messages name the message that they answer. Self-joins double the distance that each message sees: after
round r it knows its ancestor 2^r above, how deep it stands (so far) and the sum of the scores on the way,
so the deepest tree takes the logarithm of its depth in joins, all on a number that one message has, however large
a tree is (a message with very many answers is a skewed join, which Spark splits). Leaves are ranked within their tree by the sum of the scores on their path, and the
best ``top`` are kept; the same jumps, from the longest to the shortest, list the messages of the chosen paths.

A path becomes one conversation. Each message is a turn ``### role: text</turn>`` and a line break. So that no text or
role can be taken for such a mark, a backslash is put before each backslash and inside each mark that stands in a
text; taking those away gives the text back. The mask covers the texts of one role, without marks. Turns are
gathered in blocks of about ``BLOCK`` code points, whole turns each, so most conversations are one row, and one of
any length is many: the conversation is its blocks in order. Digests of a whole conversation read its blocks in order
as a stream, one at a time; that is by nature one task's work for each conversation.

Null texts and roles are empty. A message that answers nothing, or something that is not in its tree, begins
a tree path of its own. Messages without id, and all but the first (by parent, then a hash of role and text) of those that repeat
one, are leaves that nothing answers. Messages in a cycle, or that answer into one, are on no path from a root, and
are left out. A null tree is a tree of its own. Null scores count 0; ties go to the smaller id, null last. Only branches as
they are ranked name a path: (tree, rank). An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import small_batches
from codeloom.operators.ranking import positions, running_sum, top_k
from codeloom.session import persist_table

BLOCK = 1 << 20
MASKED = "assistant"
BEGIN, SPLIT, END = "### ", ": ", "</turn>\n"
#: What a text must not hold, and how it is written instead.
ESCAPES = (("\\", "\\\\"), ("### ", "#\\## "), ("</turn>", "<\\/turn>"))
ROLE_ESCAPES = (*ESCAPES, (": ", ":\\ "))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column, pairs: Sequence[tuple[str, str]] = ESCAPES) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def chain(rows: DataFrame, tree_col: str, order_col: str, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of linear conversations as messages, each an answer to the one before: ``tree, id, parent, role, text, score``.

    Order is by ``order_col`` (null first), then role and text. Long conversations are numbered in parts.
    """
    own = rows.select(
        F.col(tree_col).alias("tree"), F.col(order_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    numbered = positions(own, [F.col("_turn"), F.col("role"), F.col("text")], F.floor(F.col("_turn") / 256), ["tree"], out="id")
    return numbered.select("tree", F.col("id").cast("long"), F.when(F.col("id") > 0, F.col("id") - 1).cast("long").alias("parent"), "role", "text", F.lit(0).cast("double").alias("score"))


def _linked(messages: DataFrame, masked: str) -> tuple[DataFrame, DataFrame]:
    """(``row, role, text`` of every message, and its place: ``row, tree, id, up, score, hash, head, body``).

    ``row`` numbers the messages, once and written, so that all joins see the same numbers; ``up`` is the row of the message
    that it answers (null: a root); ``head`` and ``body`` are lengths of the formatted turn. Texts stay behind till the end.
    """
    own = messages.select(
        "tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = persist_table(own.withColumn("row", F.monotonically_increasing_id()), "messages")
    head, body = F.length(_head()), F.length(escaped(F.col("text")))
    narrow = persist_table(own.select("row", "tree", "id", "parent", "score", F.xxhash64("role", "text").alias("hash"), head.alias("head"), body.alias("body"), (F.col("role") == masked).alias("masked")), "places")
    place = F.struct("parent", "hash", "score", "row")
    first = narrow.where("id is not null").groupBy(F.col("tree").alias("_tree"), F.col("id").alias("_id")).agg(F.min(place)["row"].alias("up"))
    joined = narrow.join(persist_table(first, "first"), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_id")), "left")
    return own.select("row", "role", "text"), persist_table(joined.drop("_tree", "_id", "parent"), "linked")


def _head() -> Column:
    return F.concat(F.lit(BEGIN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(SPLIT))


def doubled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(``row, depth, total`` of all messages that a root leads to, and ``row, up`` by distance 1, 2, 4 ...)

    ``links``: ``row, up, score``; every ``up`` is a row. Each round is written, so lineage stays short.
    """
    state = persist_table(links.select("row", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "paths")
    jumps, left = [], state.where("up is not null").count()
    while left:
        lower = state.where("up is not null")
        jumps.append(lower.select("row", "up"))
        above = state.select(F.col("row").alias("_row"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        moved = lower.join(above, F.col("up") == F.col("_row")).select(
            "row", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        state = persist_table(state.where("up is null").unionByName(moved), "paths")
        now = state.where("up is not null").count()
        if now == left:  # what is left goes round in a cycle
            break
        left = now
    return state.where("up is null").drop("up"), jumps


@dataclass(frozen=True)
class Chosen:
    """The branches that were chosen: ``tree, rank, leaf, at, row`` and lengths of each message, and the texts by row."""

    steps: DataFrame
    texts: DataFrame

    def messages(self) -> DataFrame:
        """``tree, rank, leaf, at, role, text``: the messages in order from the root."""
        return self.steps.join(self.texts, "row").select("tree", "rank", "leaf", "at", "role", "text")


def paths(messages: DataFrame, top: int = 1, masked: str = MASKED) -> Chosen:
    """The ``top`` best branches of each tree; ``leaf`` is the id of a branch's last message.

    ``messages``: ``tree, id, parent, role, text, score``. ``masked``: the role whose texts are under the loss mask.
    """
    texts, own = _linked(messages, masked)
    reached, jumps = doubled(own.select("row", "up", "score"))
    answered = own.where("up is not null").select(F.col("up").alias("row")).distinct()
    leaves = reached.join(answered, "row", "left_anti").join(own.select("row", "tree", F.col("id").alias("leaf"), "hash"), "row")
    order = [F.desc("total"), F.col("leaf").isNull(), F.col("leaf"), F.col("hash"), F.col("row")]
    chosen = top_k(leaves, ["tree"], order, top, F.pmod(F.xxhash64("row"), F.lit(64)))
    steps = persist_table(chosen.select("tree", "rank", "leaf", "row", (F.col("depth") - 1).alias("at")), "steps")
    for distance in reversed(range(len(jumps))):
        met = steps.join(jumps[distance], "row", "left")
        here, there = F.struct("row", "at"), F.struct(F.col("up").alias("row"), (F.col("at") - 2**distance).alias("at"))
        both = met.select("tree", "rank", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_s"))
        steps = both.select("tree", "rank", "leaf", "_s.row", "_s.at")
        if distance % 4 == 0:
            steps = persist_table(steps, "steps")
    return Chosen(steps.join(own.select("row", "head", "body", "masked"), "row"), texts)


def turns(chosen: Chosen) -> DataFrame:
    """``tree, rank, leaf, at, row, start, loss_start, loss_end``: places of every turn, in code points from the conversation's beginning.

    The loss places are null for turns outside the mask.
    """
    size = F.col("head") + F.col("body") + len(END)
    summed = running_sum(chosen.steps, size, [F.col("at")], F.floor(F.col("at") / 256), ["tree", "rank"], out="_end")
    start = F.col("_end") - size
    first = start + F.col("head")
    return summed.select(
        "tree", "rank", "leaf", "at", "row", start.alias("start"), F.when(F.col("masked"), first).alias("loss_start"), F.when(F.col("masked"), first + F.col("body")).alias("loss_end"),
    )


def conversations(chosen: Chosen, block: int = BLOCK) -> DataFrame:
    """``tree, rank, leaf, block, start, text, loss``: formatted conversations in blocks of whole turns.

    ``loss`` lists the masked places of the block's text, in code points from the block's beginning.
    """
    turn = F.concat(_head(), escaped(F.col("text")), F.lit(END)).alias("turn")
    placed = turns(chosen).withColumn("block", F.floor(F.col("start") / block)).join(chosen.texts.select("row", turn), "row")
    row = F.struct("at", "start", "turn", "loss_start", "loss_end")
    grouped = placed.groupBy("tree", "rank", "block").agg(F.first("leaf").alias("leaf"), F.array_sort(F.collect_list(row)).alias("_t"))
    start = F.get("_t", F.lit(0))["start"]
    loss = F.transform(F.filter("_t", lambda t: t["loss_start"].isNotNull()), lambda t: F.struct((t["loss_start"] - start).alias("start"), (t["loss_end"] - start).alias("end")))
    return grouped.select("tree", "rank", "leaf", "block", start.alias("start"), F.array_join(F.col("_t.turn"), "").alias("text"), loss.alias("loss"))


def parsed(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation, or of a block."""
    out = []
    for turn in text.split(END)[:-1]:
        if not turn.startswith(BEGIN) or SPLIT not in turn:
            raise ValueError("this is no formatted turn")
        role, body = turn[len(BEGIN) :].split(SPLIT, 1)
        out.append((unescaped(role), unescaped(body)))
    return out


def _digested(tree: pa.Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, totals, hashes = None, [0, 0, 0], []

        def closed() -> pa.RecordBatch:
            values = [now[0], totals[0], hashes[0].hexdigest(), totals[1], hashes[1].hexdigest(), totals[2]]
            kinds = [tree.type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k in range(batch.num_rows):
                key, rank, text, loss = (batch.column(c)[k].as_py() for c in ("tree", "rank", "text", "loss"))
                if now != (key, rank):
                    if now:
                        yield closed()
                    now, totals, hashes = (key, rank), [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                for role, said in parsed(text):
                    totals[0] += 1
                    hashes[0].update(f"{role}\n{said}\n".encode())
                for place in loss:
                    under = unescaped(text[place["start"] : place["end"]])
                    totals[1] += len(under)
                    hashes[1].update(under.encode())
                totals[2] += len(text)
        if now:
            yield closed()

    return run


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text and mask alone: turns, masked text and lengths as counts and SHA-256."""
    small_batches(blocks.sparkSession)
    ordered = blocks.select("tree", "rank", "block", "text", "loss").repartition("tree", "rank").sortWithinPartitions("tree", "rank", "block")
    tree = pa.schema(ordered.select("tree").limit(0).toArrow().schema).field("tree")
    kind = blocks.schema["tree"].dataType.simpleString()
    columns = f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(_digested(tree), columns)
