"""Ranked lexical search of all documents for a set of queries: short lists term by term, long lists document by document.

First pass: every document is cut into terms (maximal runs of ASCII letters and digits and of all other than ASCII; A-Z
lower-cased) and keeps its length and the places of the queries' terms in it. Sums over all documents
give N, L and each term's df. Second pass: documents come in shards, each with a posting list per term. For a
query the shortest lists, up to ``SHORT`` of the shard's documents in postings, are added up into accumulators (term at
a time). The accumulators, sorted by document, are then one more list with the largest of them as its bound, beside the
long lists, whose bounds are their largest contributions, in the shard and in each run of ``RUN`` documents.
Lists whose bounds together stay below the k-th best score so far lead to no document; runs of documents that cannot
reach it are skipped; the other documents of the leading lists are scored list by list, largest bound first, as long as
they still can reach it (document at a time, run after run, each raising the score to beat for the next). What was
best so far goes on from shard to shard of a task; the tasks' lists are merged.

Scores are the contract's whole numbers: a term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is
10 + (90 n N) div L, and a document gains w ((10^9 tf) div (1000 tf + 8 m)) for each of the query's terms. A score of 0 is
no result; ties go to the smaller id, null last. Terms are compared by 64-bit hashes.

The queries are a stated set: they go to all tasks in blocks of at most ``BLOCK_TERMS`` terms, a pass over the documents
for each block. Queries that share an id are one, of all their terms; those without id, or without terms, have no
result. Every row of the documents is one document, rows that repeat an id too; null and empty texts have no
terms. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import slices, small_batches, words
from codeloom.operators.ranking import top_k
from codeloom.session import persist_table

TOP = 10
SHARD, SHORT, RUN = 8192, 0.5, 512
BLOCK_TERMS, POSTINGS = 250_000, 2_000_000  # terms of a block of queries; postings of a shard
#: 1 for the bytes of terms: digits, letters, and all beyond ASCII.
TERM_BYTES = np.zeros(256, np.uint8)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTES[_first : _last + 1] = 1


# --- queries -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Queries:
    """A block of queries: their ids, the sorted hashes of all their terms, and each one's terms as places among these."""

    ids: list[int]
    terms: np.ndarray
    lists: list[np.ndarray]


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, first = words(batch.column("text"), TERM_BYTES)
        ids = np.repeat(np.arange(batch.num_rows), np.diff(first))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids)), pa.array(hashes.view(np.int64))], ["id", "term"])


def blocks_of(queries: DataFrame, id_col: str, text_col: str, most: int = BLOCK_TERMS) -> Iterator[Queries]:
    """The queries in blocks of at most ``most`` terms (one query at least), in order of their ids."""
    own = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = own.mapInArrow(_terms_of, "id bigint, term bigint").distinct()
    grouped = persist_table(terms.groupBy("id").agg(F.collect_set("term").alias("terms")), "queries")
    ids: list[int] = []
    lists: list[np.ndarray] = []

    def closed() -> Queries:
        every = np.unique(np.concatenate(lists))
        return Queries(list(ids), every, [np.searchsorted(every, x) for x in lists])

    for row in grouped.orderBy("id").toLocalIterator():
        found = np.array(row["terms"], np.int64).view(np.uint64)
        if ids and sum(map(len, lists)) + len(found) > most:
            yield closed()
            ids, lists = [], []
        ids.append(row["id"])
        lists.append(found)
    if ids:
        yield closed()


# --- first pass: documents as the places of the queries' terms -----------------------------

def _counted(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``id, n, terms, tfs``: places of known terms in a document, ascending, and how often they occur."""
    bits = np.zeros(1 << 20, bool)
    bits[(terms & np.uint64(bits.size - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, first = words(batch.column("text"), TERM_BYTES)
            may = np.flatnonzero(bits[(hashes & np.uint64(bits.size - 1)).astype(np.int64)])
            place = np.searchsorted(terms, hashes[may])
            place[place == len(terms)] = 0
            hit = terms[place] == hashes[may]
            doc = np.searchsorted(first, may[hit], side="right") - 1
            cells, tfs = np.unique(doc * len(terms) + place[hit], return_counts=True)
            ends = np.searchsorted(cells, np.arange(batch.num_rows + 1) * len(terms)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % len(terms), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(first)), *lists], ["id", "n", "terms", "tfs"])

    return run


def counted(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = own.mapInArrow(_counted(queries.terms), "id bigint, n bigint, terms array<int>, tfs array<int>")
    return persist_table(found.where("n > 0"), "counted")


# --- second pass: shards -------------------------------------------------------------------

class Best:
    """The k best scores of a query so far, with the ids they belong to."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A new document needs this much at least."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Shard:
    """Posting lists of some documents: for each term the documents in order, and what they gain by it."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, gains: np.ndarray) -> None:
        order = np.lexsort((docs, terms))
        self.ids, self.docs, self.gains = ids, docs[order], gains[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.runs = -(-len(ids) // RUN)
        self.bounds = np.maximum.reduceat(self.gains, self.first[:-1]) if len(order) else np.empty(0, np.int64)
        self.run_bounds: dict[int, np.ndarray] = {}  # of long lists, as they are asked for

    def _in_runs(self, key: int, docs: np.ndarray, gains: np.ndarray) -> np.ndarray:
        known = self.run_bounds.get(key) if key >= 0 else None
        if known is None:
            known = np.zeros(self.runs, np.int64)
            np.maximum.at(known, docs // RUN, gains)
            if key >= 0:
                self.run_bounds[key] = known
        return known

    def search(self, asked: np.ndarray, best: Best) -> None:
        """Documents of this shard that belong among the best for a query, given by the places of its terms."""
        at = np.searchsorted(self.terms, asked)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == asked)] if len(self.terms) else at[:0]
        at = at[self.bounds[at] > 0]
        if not len(at):
            return
        sizes = self.first[at + 1] - self.first[at]
        at = at[np.argsort(sizes, kind="stable")]
        sizes = np.sort(sizes, kind="stable")
        n_short = int(np.searchsorted(np.cumsum(sizes), SHORT * len(self.ids), side="right"))
        lists = [(self.docs[a:b], self.gains[a:b], int(k)) for k, a, b in zip(at[n_short:], self.first[at[n_short:]], self.first[at[n_short:] + 1])]
        if n_short:  # term at a time
            places = np.concatenate([np.arange(self.first[k], self.first[k + 1]) for k in at[:n_short]])
            total = np.zeros(len(self.ids), np.int64)
            np.add.at(total, self.docs[places], self.gains[places])
            held = np.flatnonzero(total)
            lists.append((held, total[held], -1))
        bound = np.array([gains.max() for _, gains, _ in lists])
        order = np.argsort(-bound, kind="stable")
        lists, bound = [lists[i] for i in order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the lists from here on can add at most
        in_runs = np.stack([self._in_runs(key, docs, gains) for docs, gains, key in lists])
        for run in np.argsort(-in_runs.sum(axis=0), kind="stable"):  # document at a time, most promising runs first
            least = best.least
            if in_runs[:, run].sum() < least:
                break
            leading = int(np.argmax(rest < least))  # the lists from here on lead to no document
            low, high = run * RUN, min((run + 1) * RUN, len(self.ids))
            score, open_ = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
            left = np.append(np.cumsum(in_runs[::-1, run])[::-1], 0)
            for k, (docs, gains, _) in enumerate(lists):
                a, b = np.searchsorted(docs, (low, high))
                score[docs[a:b] - low] += gains[a:b]
                if k < leading:
                    open_[docs[a:b] - low] = True
                if k >= leading - 1:
                    open_ &= score + left[k + 1] >= least
                    if not open_.any():
                        break
            else:
                found = np.flatnonzero(open_ & (score >= least))
                if len(found):
                    best.add(score[found], self.ids[found + low])


NO_ID = np.iinfo(np.int64).max  # a document without id stands after all ids


def _searched(queries: Queries, weights: np.ndarray, k: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.ids]

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = np.array(rows.column("id").fill_null(NO_ID))
            lists, tfs = rows.column("terms").combine_chunks(), np.array(rows.column("tfs").combine_chunks().flatten(), dtype=np.int64)
            sizes, terms = np.diff(np.array(lists.offsets)), np.array(lists.flatten())
            docs = np.repeat(np.arange(len(ids)), sizes)
            m = np.repeat(np.array(rows.column("m")), sizes)
            part = Shard(ids, terms, docs, weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m)))
            for asked, own in zip(queries.lists, best):
                part.search(asked, own)

        held, n, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                some = batch.slice(at, shard)
                more = len(some.column("terms").flatten())
                if held and (n + some.num_rows > shard or postings + more > POSTINGS):
                    search(held)
                    held, n, postings = [], 0, 0
                held.append(some)
                n, postings = n + some.num_rows, postings + more
        if held:
            search(held)
        out = [(q, None if i == NO_ID else int(i), int(s)) for q, own in zip(queries.ids, best) for i, s in zip(own.ids, own.scores)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
           k: int = TOP, shard: int = SHARD, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each query."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for block in blocks_of(queries, query_id, query_text, block_terms):
        rows = counted(docs, block, id_col, text_col)
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weights = np.zeros(len(block.terms), np.int64)
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row for each term of the block
        weights[df["term"].to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df["df"].to_pylist()]
        long = rows.select("id", F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L").alias("m"), "terms", "tfs")
        made = long.mapInArrow(_searched(block, weights, k, shard), "item_id bigint, doc_id bigint, score bigint")
        found = found.unionByName(persist_table(made, "found"))
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    return top_k(found, ["item_id"], order, k, F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).select("item_id", "rank", "doc_id", "score")
