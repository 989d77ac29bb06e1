"""Helpers shared by the operators: checked broadcasts, hashed words, numbers from hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.session import persist_table

BROADCAST_ROWS = 1_000_000  # rows of two or three numbers each; beyond it the join is shuffled
BATCH_BYTES = 4 << 20  # of the rows that travel to Python at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, to be broadcast only if a count shows at most ``limit`` rows."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def small_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python in bytes; a smaller bound of the session's own stays.

    Each is held in the JVM, where its buffers grow by doubling, and once more in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key).removesuffix("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lowered(text: Column) -> Column:
    """Text with A-Z, and nothing else, in lower case (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows whose id and text are in ``bad`` (``doc_id, text_hash``; null ids are equal)."""
    bad = persist_table(bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct(), "left-out")  # counted, then joined
    bad = small_side(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (text_hash(docs[text_col]) == bad["_text"]), "left_anti")


def uniform(seed: int | str, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**12))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        sizes = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        part = np.cumsum(sizes) // most_bytes
        cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


# --- words as numbers --------------------------------------------------------------------

def _fixed(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same everywhere."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = _fixed(11, 256)
POWER = np.uint64(0xD1342543DE82EF95)
#: 1 for every byte but the white space \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row's begin (null: empty)."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind other than 0, never across rows: begins, ends, first run of each row."""
    kind = kinds[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    if len(edges) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = kind[edges[:-1]] > 0
    begins, ends = edges[:-1][word], edges[1:][word]
    return begins, ends, np.searchsorted(begins, offsets)


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``POWER`` from the first, and those of its inverse from the one."""
    inverse = np.full(size, np.uint64(pow(int(POWER), -1, 1 << 64)))
    inverse[0] = 1
    return np.cumprod(np.full(size, POWER)), np.cumprod(inverse)


def hash_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of each run's bytes: a sum by powers of the place, taken from running sums over all bytes (runs are in order)."""
    out = np.empty(len(begins), np.uint64)
    for at in range(0, len(begins), chunk):
        b, e = begins[at : at + chunk], ends[at : at + chunk]
        some = data[b[0] : e[-1]]
        powers, inverse = _powers(1 << max(18, len(some).bit_length()))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[some] * powers[: len(some)], out=sums[1:])
        out[at : at + chunk] = mix((sums[e - b[0]] - sums[b - b[0]]) * inverse[b - b[0]] + (e - b).astype(np.uint64))
    return out


def words(column: pa.Array, kinds: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and where each row's begin."""
    data, offsets = flat(column)
    if lower:
        data = ASCII_LOWER[data]
    begins, ends, first = runs(data, offsets, kinds)
    return hash_runs(data, begins, ends), first


def grams(hashes: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Hash of each n consecutive numbers (empty if there are fewer)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    weights = _fixed(seed, n)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * weights[k]
    return mix(total + np.uint64(n))
