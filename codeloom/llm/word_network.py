"""The network of the masked pseudo-likelihood: every modelled word has its own input and its own output.

Words are counted exactly, in a table keyed by their hash. The most frequent ones are modelled, ``GROWTH`` times
the root of the corpus's number of words, or ``LEAST`` if that is more (equally frequent words together or not at all); they are dealt by rank to classes, of few words where words are frequent. The chance of a word is that of
its class times that of the word within its class, two softmaxes that both see the words before and after. All
other words share the class RARE, whose chance depends on the context; within it a word has its exact share of the counts.

Each place has a matrix, applied to the embedding of the word there; words of class RARE, and the text's edges, have an
embedding each. Training starts at the unigram shares and takes Adagrad steps over the rows that a batch touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import slices, words

LEAST, GROWTH, SIDE, HIDDEN, BATCH, STEP, SEED = 10_000, 1, 2, 16, 16384, 0.1, 41
BLOCK, BITS = 1024, 18  # words whose scores are held at a time; of a hash, by which it is looked up
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
COLUMNS = 2 * HIDDEN + 1  # of a row: what the word is as input, what it is as output, its bias


@dataclass(frozen=True)
class Words:
    hashes: np.ndarray  # of the modelled words, sorted
    rank: np.ndarray  # of each
    counts: np.ndarray  # by rank
    total: int  # words of the corpus

    @property
    def n(self) -> int:
        return len(self.hashes)

    @cached_property
    def groups(self) -> np.ndarray:
        """The class of each rank, and last that of rare words.

        A word costs the classes and the words of its own one. That is least on average if there are as many classes as the
        roots of all shares add up to, and each has its part of them: the square root of n for words equally frequent.
        """
        roots = np.sqrt(self.counts / max(self.total, 1))
        before = np.cumsum(roots) - roots
        deal = np.floor(before * (np.ceil(roots.sum()) / max(roots.sum(), 1e-9)))
        group = np.cumsum(np.diff(deal, prepend=deal[:1]) > 0)
        return np.append(group, group[-1:].sum() + (self.n > 0))

    @cached_property
    def starts(self) -> np.ndarray:
        """First rank of each class of words, and n."""
        return np.append(np.flatnonzero(np.diff(self.groups[:-1], prepend=-1)), self.n)

    @property
    def classes(self) -> int:
        return len(self.starts)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks; n for rare words."""
        if not self.n:
            return np.zeros(len(hashes), np.int64)
        first, most = self._table
        place = first[hashes >> np.uint64(64 - BITS)]
        out = np.full(len(hashes), self.n)
        for k in range(most):
            at = np.minimum(place + k, self.n - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            out[hit] = self.rank[at[hit]]
        return out

    @cached_property
    def _table(self) -> tuple[np.ndarray, int]:
        """Where the hashes that begin with the same bits begin, and the most that do."""
        first = np.searchsorted(self.hashes, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))
        return first.astype(np.int32), int(np.diff(first, append=self.n).max())


class Net:
    """Rows of words (n), the rare word and the edge; of classes; of the places' matrices; the bias of the hidden values."""

    def __init__(self, known: Words, rows: np.ndarray) -> None:
        self.known, self.rows = known, rows
        n, c = known.n + 2, known.classes
        self.input, self.output, self.bias = rows[:n, :HIDDEN], rows[:n, HIDDEN:-1], rows[:n, -1]
        self.class_output, self.class_bias = rows[n : n + c, :HIDDEN], rows[n : n + c, -1]
        self.at = [n + c + HIDDEN * k for k in range(len(PLACES) + 1)]
        self.matrices = [rows[a : a + HIDDEN, :HIDDEN] for a in self.at[:-1]]
        self.hidden_bias = rows[-1, :HIDDEN]

    @staticmethod
    def start(known: Words) -> Net:
        rng = np.random.default_rng(SEED)
        n, c = known.n + 2, known.classes
        rows = np.zeros((n + c + HIDDEN * len(PLACES) + 1, COLUMNS), np.float32)
        net = Net(known, rows)
        net.input[:] = rng.normal(0, 0.3, (n, HIDDEN))
        for m in net.matrices:
            m[:] = rng.normal(0, 0.4, (HIDDEN, HIDDEN))
        group = known.groups[:-1]
        sums = np.append(np.bincount(group, known.counts, c - 1), max(known.total - known.counts.sum(), 0.5))
        net.class_bias[:] = np.log(sums / sums.sum())
        net.bias[: known.n] = np.log(known.counts / sums[group])
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden values and a 1, which meets the bias; the embeddings of all places side by side."""
        inputs = np.take(np.ascontiguousarray(self.input), context, axis=0).reshape(len(context), -1)
        sums = inputs @ np.concatenate(self.matrices)
        sums += self.hidden_bias
        out = np.ones((len(context), HIDDEN + 1), np.float32)
        np.tanh(sums, out=out[:, :-1])
        return out, inputs

    def softmaxes(self, target: np.ndarray) -> Iterator[tuple[slice | None, slice, np.ndarray, bool]]:
        """Each softmax: its ranks (None: the classes), where the targets, which are sorted, meet it, its rows and whether they are safe (:func:`_moved`)."""
        classes = np.concatenate([self.class_output, self.class_bias[:, None]], axis=1)
        rows, safe = _moved(classes, np.zeros(1, np.int64))
        for at in range(0, len(target), BLOCK):
            yield None, slice(at, at + BLOCK), rows, bool(safe[0])
        starts = self.known.starts
        cuts = np.searchsorted(target, starts)
        rows, safe = _moved(self.rows[: self.known.n, HIDDEN:], starts[:-1])
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(int(starts[c]), int(starts[c + 1]))
            yield own, slice(int(cuts[c]), int(cuts[c + 1])), rows[own], bool(safe[c])

    def logs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log chance of each target; of a rare word, that of its class."""
        order = _sorted(target, self.known.n + 1)
        context, target = context[order], target[order]
        hidden, _ = self.hidden(context)
        group, sums = self.known.groups[target], np.zeros(len(target), np.float32)
        for own, some, moved, safe in self.softmaxes(target):
            exps, top = _exponents(hidden[some], moved, safe)
            answers = moved[group[some] if own is None else target[some] - own.start]
            sums[some] += np.einsum("ij,ij->i", hidden[some], answers) - np.ravel(top) - np.log(exps @ np.ones(len(moved), np.float32))
        out = np.empty(len(target))
        out[order] = sums
        return out

    def learn(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One step of Adagrad, in place."""
        n, c = self.known.n + 2, self.known.classes
        order = _sorted(target, n)
        context, target = context[order], target[order]
        hidden, inputs = self.hidden(context)
        group, modelled = self.known.groups[target], slice(0, int(np.searchsorted(target, self.known.n)))
        back = np.take(-self.class_output, group, axis=0)
        back[modelled] -= np.take(np.ascontiguousarray(self.output), target[modelled], axis=0)
        by_class, by_word = np.zeros((c, HIDDEN + 1), np.float32), np.zeros((self.known.n, HIDDEN + 1), np.float32)
        for own, some, moved, safe in self.softmaxes(target):
            exps, _ = _exponents(hidden[some], moved, safe)
            moved = moved.copy()
            moved[:, -1] = 1  # so that the last sum is that of the exponentials
            sums = exps @ moved
            shares = 1 / sums[:, -1:]
            back[some] += sums[:, :-1] * shares
            if own is None:
                by_class += exps.T @ (hidden[some] * shares)
            else:
                by_word[own] = exps.T @ (hidden[some] * shares)
        _less_own(by_class, group, hidden)
        _less_own(by_word, target[modelled], hidden[modelled])
        changes = [(slice(n, n + c), slice(0, HIDDEN), by_class[:, :HIDDEN]), (slice(n, n + c), slice(-1, None), by_class[:, HIDDEN:]), (slice(0, self.known.n), slice(HIDDEN, None), by_word)]
        back *= 1 - hidden[:, :HIDDEN] * hidden[:, :HIDDEN]
        changes.append((slice(self.at[0], self.at[-1]), slice(0, HIDDEN), inputs.T @ back))
        changes.append((slice(self.at[-1], None), slice(0, HIDDEN), back.sum(axis=0)[None]))
        places = context.ravel()
        for x in (self.known.n, self.known.n + 1):  # the rare word and the edge, which stand in most places, by one product
            there = (context == x).astype(np.float32).T @ back
            changes.append((slice(x, x + 1), slice(0, HIDDEN), sum(t @ m.T for t, m in zip(there, self.matrices))[None]))
        some = np.flatnonzero(places < self.known.n)
        if len(some):
            some = some[_sorted(places[some], n)]
            rows, first = _starts(places[some])
            grads = (back @ np.concatenate(self.matrices).T).reshape(-1, HIDDEN)
            grads = np.take(grads, some, axis=0).view(np.complex64)  # sums of pairs take half the time
            changes.append((rows, slice(0, HIDDEN), np.add.reduceat(grads, first, axis=0).view(np.float32)))
        for at, columns, change in changes:
            squares[at, columns] += change * change
            self.rows[at, columns] -= STEP * change / np.sqrt(squares[at, columns])


def _sorted(values: np.ndarray, n: int) -> np.ndarray:
    """The stable order of numbers below n, by radix if they are short."""
    return np.argsort(values.astype(np.uint16) if n <= 1 << 16 else values, kind="stable")


def _starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted list and where each begins."""
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], first


def _moved(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with their biases less one number for each softmax, and whether that keeps its exponentials in range.

    Hidden values lie between -1 and 1, so a score is within its weights' sum of its bias. The highest that any may be is
    taken off: then none overflows, and the largest of a text does not underflow if the bounds are close.
    """
    reach = np.abs(rows[:, :HIDDEN]).sum(axis=1)
    if not len(rows):
        return rows, np.zeros(0, bool)
    most, least = np.maximum.reduceat(rows[:, -1] + reach, starts), np.maximum.reduceat(rows[:, -1] - reach, starts)
    moved = rows.copy()
    moved[:, -1] -= np.repeat(most, np.diff(starts, append=len(rows)))
    return moved, most - least < 60


def _exponents(hidden: np.ndarray, moved: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | np.float32]:
    """Exponentials of all scores, and what was taken from them first: each text's largest, unless the rows are safe."""
    scores = hidden @ moved.T
    if not safe:
        top = scores.max(axis=1, keepdims=True)
        scores -= top
        return np.exp(scores, out=scores), top
    return np.exp(scores, out=scores), np.float32(0)


def _less_own(change: np.ndarray, answer: np.ndarray, hidden: np.ndarray) -> None:
    """Take the hidden values of each text from the gradient of its (sorted) answer."""
    if len(answer):
        own, first = _starts(answer)
        change[own] -= np.add.reduceat(hidden, first, axis=0)


def contexts(ids: np.ndarray, first: np.ndarray, edge: int) -> np.ndarray:
    """Ranks around each word; words of other rows count as the edge."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(ids), len(PLACES)), edge, np.int32)
    for k, place in enumerate(PLACES):
        size = max(0, len(ids) - abs(place))
        here, there = (slice(abs(place), None), slice(0, size)) if place < 0 else (slice(0, size), slice(abs(place), None))
        out[here, k] = np.where(row[here] == row[there], ids[there], edge)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text", 8_000_000):
        hashes, n = np.unique(words(batch.column("_text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])


def counted(texts: DataFrame) -> DataFrame:
    """``hash, n`` of every word."""
    return texts.mapInArrow(_counted, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def modelled(counts: DataFrame) -> Words:
    steps = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow()  # as many rows as there are different counts
    n, some = (np.array(steps.column(c), dtype=np.int64) for c in ("n", "words"))
    order = np.argsort(-n)
    total = int((n * some).sum())
    fit = np.flatnonzero(np.cumsum(some[order]) <= max(LEAST, GROWTH * np.sqrt(total)))
    top = counts.where(F.col("n") >= (int(n[order][fit[-1]]) if len(fit) else total + 1)).toArrow()
    hashes, n = np.array(top.column("hash"), dtype=np.int64).view(np.uint64), np.array(top.column("n"), dtype=np.float64)
    by_rank, by_hash = np.lexsort((hashes, -n)), np.argsort(hashes)
    rank = np.empty(len(n), np.int64)
    rank[by_rank] = np.arange(len(n))
    return Words(hashes[by_hash], rank[by_hash], n[by_rank], total)


def _learned(known: Words, start: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Net(known, start.copy()), 0
        squares, met = np.ones_like(start), np.zeros(known.n + 2)
        for batch in slices(batches, "_text"):
            hashes, first = words(batch.column("_text"))
            ids = known.ids(hashes)
            around = contexts(ids, first, known.n + 1)
            met += np.bincount(ids, minlength=known.n + 2)
            order = np.random.default_rng(SEED + seen).permutation(len(ids))
            for at in range(0, len(ids), BATCH):
                some = order[at : at + BATCH]
                net.learn(around[some], ids[some], squares)
            seen += len(ids)
        if seen:
            weight = np.full(len(start), float(seen))
            weight[: known.n + 1] = met[:-1]
            # Rows that moved only as other answers of their class count as met once.
            weight[: known.n] = np.maximum(weight[: known.n], 1)
            kept = np.flatnonzero((net.rows != start).any(axis=1))
            sums = net.rows[kept] * weight[kept, None]
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weight[kept]), *(pa.array(sums[:, k].astype(np.float64)) for k in range(COLUMNS))], ["at", "weight", *(f"v{k}" for k in range(COLUMNS))])

    return run


def train(texts: DataFrame, known: Words, epochs: int = 1) -> Net:
    """Every task learns from its own documents; rows are averaged by how often a task has met their word."""
    net = Net.start(known)
    names = [f"v{k}" for k in range(COLUMNS)]
    for _ in range(epochs):
        learned = texts.mapInArrow(_learned(known, net.rows), "at bigint, weight double, " + ", ".join(f"{v} double" for v in names))
        sums = learned.groupBy("at").agg(*(F.sum(v).alias(v) for v in ("weight", *names))).toArrow()
        rows = net.rows.copy()
        values = np.stack([np.array(sums.column(v), dtype=np.float64) for v in names], axis=1) if sums.num_rows else np.empty((0, COLUMNS))
        rows[np.array(sums.column("at"), dtype=np.int64)] = values / np.array(sums.column("weight"), dtype=np.float64)[:, None]
        net = Net(known, rows)
    return net


def log_chances(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word, given the words round it (of a rare word, that of its class)."""
    around = contexts(ids, first, net.known.n + 1)
    return np.concatenate([np.empty(0), *(net.logs(around[at : at + BATCH], ids[at : at + BATCH]) for at in range(0, len(ids), BATCH))])


def _scored(known: Words, rows: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(known, rows)
        for batch in slices(batches, "_text"):
            hashes, first = words(batch.column("_text"))
            ids = known.ids(hashes)
            sums = np.append(0, np.cumsum(log_chances(net, ids, first)))
            rare = ids == known.n
            lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(rare))[first], pa.array(hashes[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(first)), pa.array(np.diff(sums[first])), lists.cast(pa.list_(pa.int64()))], ["doc_id", "n_words", "_sum", "_rare"])

    return run


def score(own: DataFrame, counts: DataFrame, net: Net) -> DataFrame:
    """Per row of ``_id, _text``: ``doc_id, n_words, log_likelihood``."""
    kind = own.schema["_id"].dataType.simpleString()
    scored = own.mapInArrow(_scored(net.known, net.rows), f"doc_id {kind}, n_words bigint, _sum double, _rare array<bigint>").withColumn("_row", F.monotonically_increasing_id())
    left = max(net.known.total - float(net.known.counts.sum()), 1.0)
    # A row with no rare word keeps one entry without a hash; the document's own numbers travel with one entry only.
    flat = scored.select("_row", "doc_id", "n_words", "_sum", F.posexplode_outer("_rare").alias("_k", "hash"))
    first = F.coalesce(F.col("_k"), F.lit(0)) == 0
    flat = flat.select("_row", "hash", *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_words", "_sum")))
    joined = flat.join(counts.where("n > 1"), "hash", "left")
    share = F.when(F.col("hash").isNotNull(), F.log(F.coalesce(F.col("n"), F.lit(1)) / F.lit(left)))
    sums = joined.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("_sum").alias("_sum"), F.sum(share).alias("_share"))
    return sums.select("doc_id", "n_words", (F.col("_sum") + F.coalesce("_share", F.lit(0.0))).alias("log_likelihood"))
