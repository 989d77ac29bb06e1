"""Quality classifier by importance resampling over hashed n-grams.

Tokens are runs of letters (all non-ASCII bytes count as letters), of digits, or of other marks. A text's n-grams are
its tokens, its pairs of tokens (a token that repeats the one before gives one common pair) and triples of
token shapes, hashed into 2^20 buckets. Two generative models are counted: raw text, over every
document, and target text, over a bounded sample of documents labelled good and not toxic. With a the
target's share of the labelled n-grams, a p_target / p_raw is the chance that an n-gram of raw text comes from
the target part; its log, smoothed towards 0 in rare buckets, is averaged over a document's n-grams, as a
sum would weigh length rather than quality. Documents are drawn by Gumbel top-k: the k largest of
``SHARPNESS`` * log weight + Gumbel noise, the noise from a seed and the id. k is the number of documents whose
log weight is above a border half way between the ``LOST`` quantile of the good labelled documents and the
1 - ``LOST`` quantile of the bad ones (the former, if they overlap). Counts travel as sums per task and
bucket, and the k-th largest key is found by refining a histogram, so nothing but sums of fixed length
reaches the driver.

Null and empty texts have no n-grams and log weight 0. Documents without id share one noise value. Rows that
repeat an id are drawn as rows of their own with one noise; rows tied with the k-th largest are all drawn. Labels with
a null are not used; of contradicting labels the worse count. Without any
good label all documents are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import ASCII_LOWER, flat, hash_runs, mix, runs, slices, small_batches, text_hash, uniform, without
from codeloom.session import persist_table

BUCKETS = 1 << 20
LABELLED = 50_000  # labelled documents that the target model and the border are fitted on, picked by hash
SMOOTH, SHARPNESS, LOST, SEED = 128.0, 64.0, 0.005, 29
CELLS, FEW = 1 << 16, 100_000
SLICE_BYTES = 1_000_000  # of texts cut into n-grams at a time

_KINDS = np.full(256, 1, np.uint8)  # letters
_KINDS[:128] = 3  # marks
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[48:58] = 2
_KINDS[65:91] = _KINDS[97:123] = 1


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a column, and the row of each."""
    data, offsets = flat(column)
    begins, ends, first = runs(data, offsets, _KINDS)
    rows = np.repeat(np.arange(len(column)), np.diff(first))
    if not len(begins):
        return np.empty(0, np.int64), rows
    word = hash_runs(ASCII_LOWER[data], begins, ends)
    last = ends - 1
    upper = ((data >= 65) & (data <= 90)).astype(np.uint8)
    size = np.minimum(ends - begins, 12)
    shape = (_KINDS[data[begins]].astype(np.uint64) * 100 + upper[begins] * 50 + upper[last] * 20 + size.astype(np.uint64)).astype(np.uint64)
    same = rows[1:] == rows[:-1]
    pair = np.where(word[1:] == word[:-1], np.uint64(7), word[1:] * np.uint64(3) + word[:-1] * np.uint64(5))[same]
    both = same[1:] & same[:-1]
    triple = (shape[2:] + shape[1:-1] * np.uint64(1009) + shape[:-2] * np.uint64(1018081))[both]
    parts = [(word, rows, 1), (mix(pair), rows[1:][same], 2), (mix(triple), rows[2:][both], 3)]
    buckets = np.concatenate([mix(h + np.uint64(k)) % np.uint64(BUCKETS) for h, _, k in parts]).astype(np.int64)
    return buckets, np.concatenate([r for _, r, _ in parts])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target, labelled = (np.zeros(BUCKETS, np.int64) for _ in range(3))
    for batch in slices(batches, "_text", SLICE_BYTES):
        buckets, rows = ngrams(batch.column("_text"))
        raw += np.bincount(buckets, minlength=BUCKETS)
        good = np.array(batch.column("_good").fill_null(-1))[rows]
        if (good >= 0).any():
            labelled += np.bincount(buckets[good >= 0], minlength=BUCKETS)
            target += np.bincount(buckets[good == 1], minlength=BUCKETS)
    held = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, raw[held], target[held], labelled[held])], ["bucket", "raw", "target", "labelled"])


def _weighed(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE_BYTES):
            buckets, rows = ngrams(batch.column("_text"))
            weight = np.bincount(rows, table[buckets].astype(np.float64), minlength=batch.num_rows)
            counts = np.bincount(rows, minlength=batch.num_rows)
            weight = weight / np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), batch.column("_good"), pa.array(counts.astype(np.int64)), pa.array(weight)], ["id", "text_hash", "good", "n_ngrams", "log_weight"])

    return run


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """``_label_id, _good`` (0 bad, 1 good, 2 good but toxic) of at most ``most`` labelled documents."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    known = known.select("_label_id", F.when(F.col("_q") != 1, 0).when(F.col("_t") == 0, 1).otherwise(2).alias("_good"))
    return known.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, good, n_ngrams, log_weight`` of every document; ``good`` is known for the labelled sample."""
    small_batches(docs.sparkSession)
    sample = F.broadcast(persist_table(labelled_sample(labels), "labelled"))  # LABELLED rows at most
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), text_hash(F.col(text_col)).alias("_hash"))
    own = own.join(sample, own["_id"] == sample["_label_id"], "left").select("_id", "_hash", "_text", "_good")
    sums = own.mapInArrow(_counted, "bucket bigint, raw bigint, target bigint, labelled bigint").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "target", "labelled")])
    sums = sums.toArrow()  # BUCKETS rows at most
    bucket = np.array(sums.column("bucket"), dtype=np.int64)
    raw, target, labelled = (np.zeros(BUCKETS) for _ in range(3))
    for into, name in ((raw, "raw"), (target, "target"), (labelled, "labelled")):
        into[bucket] = np.array(sums.column(name), dtype=np.float64)
    if target.sum():
        expected = target * (raw.sum() / labelled.sum())  # a p_target as counts of raw text
        table = np.log((expected + SMOOTH) / (raw + SMOOTH)).astype(np.float32)
    else:
        table = np.zeros(BUCKETS, np.float32)
    kind = own.schema["_id"].dataType.simpleString()
    return persist_table(own.mapInArrow(_weighed(table), f"id {kind}, text_hash bigint, good int, n_ngrams bigint, log_weight double"), "log-weights")


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """Found by refining a histogram of CELLS cells until few rows or a single value are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        here = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        step = (high - low) / CELLS or 1.0
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(CELLS - 1)).alias("cell")
        cells = here.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(cells, reverse=True):  # CELLS rows at most
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["lo"], row["hi"]
        if low == high:
            return low
        if row["n"] <= FEW:
            here = rows.where((F.col(column) >= low) & (F.col(column) <= high))
            return here.orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, text_hash, n_ngrams, log_weight, key, kept``."""
    scored = score(docs, labels, id_col, text_col)
    low = scored.where("good = 1").agg(F.percentile("log_weight", F.lit(LOST))).first()[0]  # of the labelled sample
    high = scored.where("good = 0").agg(F.percentile("log_weight", F.lit(1 - LOST))).first()[0]
    border = (low + high) / 2 if low is not None and high is not None and high < low else low
    gumbel = -F.log(-F.log(uniform(seed, F.col("id"))))
    keyed = scored.withColumn("key", F.lit(SHARPNESS) * F.col("log_weight") + gumbel)
    k = keyed.where(F.col("log_weight") >= F.lit(border)).count() if border is not None else 0
    kept = F.col("key") >= F.lit(kth_largest(keyed, "key", k)) if k else F.lit(border is None)
    return keyed.select(F.col("id").alias("doc_id"), "text_hash", "n_ngrams", "log_weight", "key", kept.alias("kept"))


def keep_drawn(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that were drawn, with all their columns."""
    return without(docs, drawn.where("not kept"), id_col, text_col)
