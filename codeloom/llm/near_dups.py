"""MinHash near-duplicates through an LSH forest, links confirmed on full shingle sets.

A text's set holds its distinct shingles of five words (A-Z lowered, split on ASCII white space) as
64-bit hashes; a shorter text is one shingle. Texts with equal sets are one class. Each class has 64
MinHash values; tree t of 16 orders the classes by the values from 4t on (round the end), so classes
that share a prefix stand together. Regions are visited from deep prefixes (16 values) to the least
depth (4). At each depth only regions that still hold several components are looked at, so dense
regions are joined by their nearest neighbours first. A region is cut in blocks; each pair of blocks
is compared by signature, and the survivors' full sets confirm the links (classes without a survivor at
the least depth drop out at the start). At the threshold of 0.85 a
single link is missed by all trees with a chance of 7 in a million; nothing else is cut off.

Per row: ``doc_id, n_shingles, component_id, kept``. Texts that are null, empty or without words have
an empty set and stand alone. Rows without id stand alone too (component null, kept). Rows that repeat
an id are one document; if their texts differ it links what either links. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import _fixed, grams, slices, small_batches, small_side, words
from codeloom.session import persist_table

SHINGLE, TREES, LEAST_DEPTH = 5, 16, 4
VALUES = TREES * LEAST_DEPTH
DEPTHS = (16, 8, LEAST_DEPTH)
BLOCK = 256  # classes of a region that are compared at once
SURE = 0.23  # a signature's estimate may fall short of the similarity by this (5 standard errors)
_FACTORS = _fixed(23, VALUES)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    return np.unique(grams(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[None, at : at + 4096] * _FACTORS[:, None]) >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32)


def _mapped(with_sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            hashes, first = words(batch.column("_text"))
            found = [shingles(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
            sizes = pa.array([len(x) for x in found], pa.int64())
            signs = pa.array([signature(x).tobytes() if len(x) else None for x in found], pa.binary())
            if with_sets:
                kept = pa.array([x.tobytes() for x in found], pa.binary())
            else:
                kept = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), sizes, kept, signs], ["id", "n", "key", "sign"])

    return run


def _signed(docs: DataFrame, with_sets: bool) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(_mapped(with_sets), f"id {kind}, n bigint, key binary, sign binary")


def _region(tree: int, depth: int) -> Column:
    """Number of the region of a tree: the prefix of its order, values taken round the end."""
    return F.xxhash64(F.lit(tree), F.substring(F.concat("sign", "sign"), 4 * LEAST_DEPTH * tree + 1, 4 * depth))


def _regions(rows: DataFrame, depth: int, *cols: str) -> DataFrame:
    return rows.select(*cols, F.explode(F.array(*[_region(t, depth) for t in range(TREES)])).alias("region"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``pair``, which follow each other."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.array(batch.column("pair"))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and held[0].column("pair")[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(table.slice(a, b - a))
            if b < len(keys):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def _plausible(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that have, by signature, a partner of another component in their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            comp = np.array(rows.column("comp"))
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint32).reshape(-1, VALUES)
            alike = np.zeros((len(comp), len(comp)), np.uint8)
            for k in range(VALUES):
                alike += signs[:, k, None] == signs[None, :, k]
            near = ((alike >= least * VALUES) & (comp[:, None] != comp[None, :])).any(axis=1)
            if near.any():
                yield from rows.select(["pair", "node", "comp"]).filter(pa.array(near)).combine_chunks().to_batches()

    return run


def _common(sets: list[np.ndarray], together: int = 500_000) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by ranges of hashes that hold about ``together`` of them."""
    parts = sum(len(x) for x in sets) // together + 1
    limits = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(x, limits), len(x)] for x in sets]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for k in range(parts):
        some = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts)]
        union, place = np.unique(np.concatenate(some), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in some])
        step = max(1, 4_000_000 // len(sets))
        order = np.argsort(place, kind="stable")
        place, row = place[order], row[order]
        for at in range(0, len(union), step):
            a, b = np.searchsorted(place, [at, at + step])
            held = np.zeros((len(sets), min(step, len(union) - at)), np.float32)
            held[row[a:b], place[a:b] - at] = 1
            out += held @ held.T
    return out


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between components, as many as join what the pair of blocks joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("key")]
            node, comp = np.array(rows.column("node")), np.array(rows.column("comp"))
            both = _common(sets)
            size = np.array([len(x) for x in sets], np.float64)
            link = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] < comp[None, :])
            top: dict[int, int] = {}

            def root(x: int) -> int:
                while top.get(x, x) != x:
                    x = top[x] = top.get(top[x], top[x])
                return x

            out = []
            for i, j in np.argwhere(link).tolist():
                x, y = root(comp[i].item()), root(comp[j].item())
                if x != y:
                    top[max(x, y)] = min(x, y)
                    out.append((node[i].item(), node[j].item()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` with the smallest node reachable, by alternating large and small stars until nothing but stars is left."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = persist_table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = persist_table(small.where("a <> b").distinct(), "small-star")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
        if ends.where("ups > 1 or ups = 1 and n > 1").isEmpty():  # in a star a node points to one smaller node, or is pointed to
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Class and component of every row; sets whose similarity is ``percent`` or more are linked."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = persist_table(_signed(own, False), "signatures")
    named = rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node"), F.any_value("sign").alias("sign"))
    classes = persist_table(named, "classes")

    alone = classes.select("node", F.col("node").alias("comp"), "sign")
    near = persist_table(_close(alone, LEAST_DEPTH, percent).select("node").distinct(), "near")
    full = persist_table(_signed(own.join(small_side(near), own["_id"] == near["node"], "left_semi"), True).withColumnRenamed("id", "node"), "sets")

    edges = None
    labels = joined = near.select("node", F.col("node").alias("comp"))
    for depth in DEPTHS:
        close = persist_table(_close(full.select("node", "sign").join(labels, "node"), depth, percent), "close")
        found = _by_pair(close.join(full.select("node", "key"), "node")).mapInArrow(_confirmed(percent), "a bigint, b bigint")
        found = persist_table(found, "links")
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        joined = components(edges)
        labels = near.join(joined, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        edges = joined.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    named = classes.select("key", "node").join(joined, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    out = rows.select("id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _close(signs: DataFrame, depth: int, percent: int) -> DataFrame:
    """Classes (``pair, node, comp``) that share a region of this depth with another component and come near it by signature."""
    members = _regions(signs, depth, "node", "comp")
    mixed = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    members = members.join(mixed.select("region", F.ceil(F.col("size") / BLOCK).alias("blocks")), "region")
    members = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(depth)), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    members = members.select(pair.alias("pair"), "node", "comp").join(signs.select("node", "sign"), "node")
    return _by_pair(members).mapInArrow(_plausible(percent / 100 - SURE), "pair bigint, node bigint, comp bigint")


def _by_pair(rows: DataFrame) -> DataFrame:
    return rows.repartition("pair").sortWithinPartitions("pair")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that are kept, with all their columns; of rows that repeat an id, all or none."""
    gone = small_side(persist_table(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
