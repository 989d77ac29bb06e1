"""Benchmark decontamination: broadcast windows of the benchmark, scan the windows of every document.

Words are runs of digits, letters a-z (A-Z lowered) and all non-ASCII characters. A window is ten
consecutive words of an item; an item of one to nine words is one window of its own length. The
windows' hashes are broadcast in blocks of a fixed number of rows (one scan of the documents per
block), a document's windows are hashed in the row and exploded into the broadcast join, and every
hit is verified word by word. Only hits and one row per document are shuffled.

Null or empty texts have no words. Benchmark rows without id or words take no part; rows that
repeat an item add their windows to it. Repeated document rows each get their result. Rows of an
empty table give an empty result. Other columns of either table are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.llm.common import BROADCAST_ROWS, lowered, text_hash, without
from codeloom.session import persist_table

WINDOW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), GAP), "")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``hash, len, words, items``: each distinct window with the ids that hold it."""
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    own = own.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    cut = own.select("item", "w", "len", starts.alias("at")).select("item", "len", F.expr("slice(w, at, len)").alias("words"))
    cut = cut.groupBy("len", "words").agg(F.collect_set("item").alias("items"))
    return cut.select(F.xxhash64(F.transform("words", lambda x: F.xxhash64(x))).alias("hash"), "len", "words", "items")


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, n_items, items, spans`` (0-based word ranges, end exclusive)."""
    found = persist_table(benchmark_windows(items, window=window), "windows")
    lengths = sorted(r["len"] for r in found.select("len").distinct().collect())  # 1 to ``window``, so a few numbers
    blocks = -(-found.count() // block_rows) or 1
    parts = [found] if blocks == 1 else [found.where(F.pmod("hash", F.lit(blocks)) == k) for k in range(blocks)]
    hits = reduce(DataFrame.unionByName, [_hits(docs, part, lengths, id_col, text_col, k == 0) for k, part in enumerate(parts)])
    merged = hits.groupBy("_id", "_text", "_n", "_at", "_len").agg(F.count(F.lit(1)).alias("_copies"), F.max("_items").alias("_items"))
    before = W.partitionBy("_id", "_text").orderBy("_at", "_len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("_at") + F.col("_len")
    fresh = F.greatest(F.lit(0), end - F.greatest("_at", F.coalesce(F.max(end).over(before), F.lit(0))))
    rows = merged.withColumn("_new", fresh).groupBy("_id", "_text").agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col("_at").isNull(), F.col("_copies"))).alias("_copies"),
        F.coalesce(F.sum("_new"), F.lit(0)).alias("_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"),
        F.array_sort(F.collect_set(F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("start"), end.alias("end"))))).alias("_spans"),
    )
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_text").alias("text_hash"), F.col("_n").cast("long").alias("n_words"), F.col("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), F.col("_spans").alias("spans"),
    )


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], id_col: str, text_col: str, with_rows: bool) -> DataFrame:
    """A row per verified window of a document; with ``with_rows`` also one row per document, with null ``_at``."""
    rows = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text"), words(F.col(text_col)).alias("_w"))
    rows = rows.select("_id", "_text", "_w", F.size("_w").alias("_n"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))

    def hashed(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.col("_n") - n + 1), lambda i: F.xxhash64(F.slice("_h", i, n)))
        return F.when(F.col("_n") >= n, each).otherwise(F.array().cast("array<bigint>"))

    row = F.array(F.lit(0).cast("bigint"))  # place 0 stands for the document itself
    rows = rows.select("_id", "_text", "_w", "_n", F.posexplode(F.concat(row, *[hashed(n) for n in lengths])).alias("_p", "_v"))
    length, at, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for n in lengths:  # which length's windows a place belongs to
        inside = F.col("_p") >= before
        length, at = F.when(inside, F.lit(n)).otherwise(length), F.when(inside, F.col("_p") - before).otherwise(at)
        before = before + F.greatest(F.lit(0), F.col("_n") - n + 1)
    joined = rows.join(F.broadcast(windows), (F.col("_p") > 0) & (F.col("_v") == F.col("hash")), "left")
    joined = joined.where((F.col("_p") == 0) | F.col("hash").isNotNull()) if with_rows else joined.where(F.col("hash").isNotNull())
    joined = joined.withColumn("_len", length).withColumn("_at", at)
    same = (F.col("len") == F.col("_len")) & (F.expr("slice(_w, _at + 1, _len)") == F.col("words"))
    return joined.where((F.col("_p") == 0) | same).select("_id", "_text", "_n", "_at", "_len", F.col("items").alias("_items"))


def remove_documents(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    return without(docs, scanned.where("n_hit > 0"), id_col, text_col)


def remove_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents; hit words are cut out of the text with what stands between them and the word before."""
    bad = scanned.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_text"])
    text = docs[text_col]
    same = docs[id_col].eqNullSafe(bad["_id"]) & (text_hash(text) == bad["_text"])
    joined = docs.join(bad, same, "left")
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    left = F.filter(pieces, lambda piece, i: ~F.exists(bad["_spans"], lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.concat(F.array_join(left, ""), F.regexp_extract(text, TAIL, 0))
    return joined.select(*[(F.when(bad["_spans"].isNull(), text).otherwise(cut).alias(c) if c == text_col else docs[c]) for c in docs.columns])
