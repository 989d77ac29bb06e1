"""Exact top-k by inner product: MaxScore over shards of candidates.

A dimension is a query term; its postings in a shard are the candidates' values. A term's bound is the
largest contribution that it can make in the shard. Terms are ordered by bound; those whose bounds
together stay below the k-th best score so far are non-essential. A candidate that gains nothing from
any essential term cannot compete; the others get their essential score, and the rest of the terms are
probed, largest bound first, only for candidates that can still reach the k-th best. Candidates are dealt
to shards of about ``SHARD`` rows by a number of their row, every shard meets the whole (stated) query set in
batches, and the shards' lists are merged.

Values are floor(scale * x), x as double; scores are integers, exact at any size (beyond 64 bits they are
cut to the range). Vectors that are null, or hold a null or non-finite value, and rows without id take no
part. Shorter vectors count as padded with zeros, so an empty one scores 0 with all. Ties go to the smaller id. Rows that
repeat an id stay rows of their own: a query never meets its own row, but does meet others with its id, and each
of several queries with one id has its own ranks. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.session import persist_table

SHARD, SCALE, TOP = 2048, 1024, 10
PROBES = 4  # terms probed between two looks at what can still compete


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector``: the rows with an id and a complete, finite vector."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of whole numbers, in doubles, padded to ``width`` or the longest row."""
    sizes = np.diff(np.array(lists.offsets))
    out = np.zeros((len(lists), max(width, int(sizes.max(initial=0)))))
    values = np.floor(np.array(lists.flatten(), dtype=np.float64) * scale)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Shard:
    """Postings by term: row d holds every candidate's value in dimension d."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.numbers, self.ids, self.terms = numbers, ids, np.ascontiguousarray(rows.T)
        self.high, self.low = self.terms.max(axis=1), self.terms.min(axis=1)
        self.most = max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0))

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Up to k pairs of score and id, best first; ``own`` is the number of the query's row."""
        query = query[: len(self.terms)] if len(query) > len(self.terms) else query
        terms = self.terms[: len(query)]
        exact = self.most * np.abs(query).max(initial=0) * max(1, len(query)) < 2.0**53
        if not exact:  # beyond what doubles add exactly
            terms, query = np.vectorize(int, otypes=[object])(terms), np.vectorize(int, otypes=[object])(query)
        bound = np.maximum(query * self.high[: len(query)], query * self.low[: len(query)]) if exact else np.maximum((query[:, None] * terms).max(axis=1), 0)
        bound = np.maximum(bound, 0)
        rank = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[rank][::-1])[::-1], 0)  # what the terms from here on can add at most
        others = self.numbers != own
        some = np.flatnonzero(others)[:: max(1, len(self.ids) // (8 * k))]
        if len(some) < k:
            some = np.flatnonzero(others)
        seen = np.sort(query @ terms[:, some])[::-1]
        least = seen[k - 1] if len(seen) >= k else None  # a score that k candidates reach
        essential = len(rank) if least is None else int(np.argmax(rest < least)) if (rest < least).any() else len(rank)
        if essential and least is not None and least > 0:
            gains = (query[rank[:essential], None] * terms[rank[:essential]] > 0).any(axis=0)
            left = np.flatnonzero(others & gains)
        else:
            left = np.flatnonzero(others)
        score = query[rank[:essential]] @ terms[np.ix_(rank[:essential], left)] if essential else np.zeros(len(left))
        for at in range(essential, len(rank), PROBES):
            can = score + rest[at] >= least
            left, score = left[can], score[can]
            more = rank[at : at + PROBES]
            score = score + query[more] @ terms[np.ix_(more, left)]
        best = np.lexsort((self.ids[left], -score))[:k]
        return [(int(score[i]), int(self.ids[left[i]])) for i in best]


def _searched(k: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            shards, asks = np.array(batch.column("shard")), np.array(batch.column("ask"))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    now, held, shard = shards[a], [], None
                if not asks[a]:
                    held.append(part.select(["row", "id", "vector"]))
                    continue
                if shard is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    shard, held = Shard(np.array(rows.column("row")), np.array(rows.column("id")), _matrix(rows.column("vector").chunk(0), 0, scale)), []
                if shard is None:
                    continue
                queries, out = _matrix(part.column("vector"), 0, scale), []
                for own, asker, query in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), queries):
                    out += [(own, asker, found, min(max(score, -(2**63)), 2**63 - 1)) for score, found in shard.top(own, query, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["row", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on ``id``."""
    rows = persist_table(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-rows.count() // shard))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "row", "id", "vector")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "row", "id", "vector")
    met = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "ask")
    found = met.mapInArrow(_searched(k, scale), "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
