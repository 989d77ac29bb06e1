"""Token-id files: every document its own zstandard frame, one dictionary for all.

Ids are encoded with a given tokenizer file, closed by an end id and serialised as little-endian
unsigned integers (16 bits if the vocabulary allows, else 32). A dictionary is trained on the
serialised ids of a bounded sample (``SAMPLE_DOCS`` documents picked by hash, ``SAMPLE_BYTES`` of each).
A file row is a block: frames of documents in ascending id order one after the other, with an
index (id, offset, length, ids, ids before it in the shard) and the dictionary's SHA-256. Shards are ranges
of ids, numbered in order. Blocks are written by Spark as Parquet, so a lost executor's work is done again
and any store will do; one document is read by its block and its place in the index.

Null and empty texts have the end id only. Documents without id come first. Rows that repeat an id
are all written, next to each other, in shards that may split them; reading one document by such an id gives the first that is found. An empty table gives no block. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from codeloom.llm.common import slices, small_batches, small_side
from codeloom.session import new_folder, persist_table

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2000, 32_768, 65_536, 3
BLOCK_BYTES, BLOCK_DOCS, CACHED_WORDS, SLICE_BYTES = 1_000_000, 4096, 100_000, 1_000_000
#: Frames are compressed already; Parquet looks at its page and row group sizes after every block, not every hundred.
_BLOCK_FILES = {"compression": "none", "parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

#: Where a text may be cut: at a single space or line break between two other characters.
_SAFE = re.compile(r"(?<=\S)([ \n])(?=\S)")
#: What makes a text irregular: white space side by side, or other than a space and a line break.
_ASCII_IRREGULAR = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_OTHER_SPACES = tuple(chr(x) for x in range(128, 1 << 16) if chr(x).isspace())
_OTHERS = iter(range(256, 512))
#: Byte-level alphabet, by byte: printable ones are themselves, the others stand from 256 on.
_BYTE_CHARS = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(_OTHERS)) for b in range(256)}
_SPACE = "\u0120"  # how a byte-level vocabulary writes a space
_LEARNT_AT_ONCE = 1000  # words in one call of the tokenizer
_FIRST, _BROKEN, _SPACED = range(3)  # what stands before a word: nothing, a line break, a space


def _irregular(text: str) -> bool:
    """Not just words with a single space or line break between them."""
    if text[0].isspace() or text[-1].isspace():
        return True
    return any(x in text for x in _ASCII_IRREGULAR) or not text.isascii() and any(x in text for x in _OTHER_SPACES)


class Encoder:
    """A byte-level tokenizer that remembers words.

    No token of such a tokenizer reaches from a non-space over a single space or line break, so the ids
    of a text are those of its words, each with the space before it, put together.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.line = self._pack(self._ids("\n"))
        self.line_id = self._ids("\n")[0] if len(self._ids("\n")) == 1 else None
        self.marks = {mark: self._pack([self.tokenizer.token_to_id(mark)]) for mark in ".,;:?!" if self.tokenizer.token_to_id(mark) is not None}
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of tokens that begin with a space
        for token, place in self.tokenizer.get_vocab().items():
            self.begins[place] = token.startswith(_SPACE)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, words: list[str], before: str) -> dict[str, bytes]:
        """Runs of letters, with or without a mark after them, go to the tokenizer's model at once; other words many in a text,
        which comes apart where tokens begin with a space, or at line breaks; words with odd white space, and texts that
        come apart wrongly, word by word."""
        tokenize, kind, head, marks = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I", _SPACE if before else "", self.marks
        found: dict[str, bytes] = {}
        marked, plain, alone = [], [], []
        for word in words:
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
                found[word] = array(kind, [t.id for t in tokenize(head + mapped)]).tobytes()
            elif word[-1:] in marks and word[:-1].isalpha() and (word.isascii() or max(word) < "\u0250"):
                marked.append(word)
            elif word.split() == [word]:
                plain.append(word)
            else:
                alone.append(word)
        width = self.dtype.itemsize
        parts = [plain[at : at + _LEARNT_AT_ONCE] for at in range(0, len(plain), _LEARNT_AT_ONCE)]
        texts = [" " + " ".join(part) if before else "\n".join(part) for part in parts]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, self.dtype)
            starts = np.flatnonzero(self.begins[ids]) if before else np.append(0, np.flatnonzero(ids == self.line_id) + 1)
            if len(starts) != len(part) or before and starts[0]:
                alone += part
                continue
            packed, skip = ids.tobytes(), 0 if before else width
            ends = [*(starts[1:] * width - skip).tolist(), len(packed)]
            found.update(zip(part, [packed[a:b] for a, b in zip((starts * width).tolist(), ends)]))
        for at in range(0, len(alone), _LEARNT_AT_ONCE):
            some = alone[at : at + _LEARNT_AT_ONCE]
            for word, got in zip(some, self.tokenizer.encode_batch_fast([before + w for w in some], add_special_tokens=False)):
                found[word] = self._pack(got.ids)
        known, get = self.spaced if before else self.bare, found.get
        for word in marked:
            stem = word[:-1]
            ids = get(stem) or known.get(stem)
            if not ids:
                mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = array(kind, [t.id for t in tokenize(head + mapped)]).tobytes()
            found[word] = ids + marks[word[-1]]
        return found

    def _looked_up(self, words: list[str], known: dict[str, bytes], before: str) -> list[bytes]:
        """The serialised ids of each word. The words met first are remembered: the frequent ones are among them."""
        packed = list(map(known.get, words))
        if new := [k for k, x in enumerate(packed) if x is None]:
            found = self._learn(list(dict.fromkeys([words[k] for k in new])), before)
            for k in new:
                packed[k] = found[words[k]]
            known.update(islice(found.items(), CACHED_WORDS - len(known)))
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """The serialised ids of each text: those of its different words are looked up, and put together by place."""
        words, kinds, sizes = _cut(texts)
        if not len(words):
            return [b""] * len(texts)
        coded = words.dictionary_encode()
        different = _strings(coded.dictionary)
        key = kinds * len(different) + np.asarray(coded.indices)
        met = np.zeros(3 * len(different), bool)
        met[key] = True
        first, broken, spaced = ([different[k] for k in np.flatnonzero(x).tolist()] for x in met.reshape(3, -1))
        bare = self._looked_up(first + broken, self.bare, "")
        packed = bare[: len(first)] + [self.line + x for x in bare[len(first) :]] + self._looked_up(spaced, self.spaced, " ")

        ids = np.frombuffer(b"".join(packed), self.dtype)
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        place = (np.cumsum(met) - 1)[key]
        taken = length[place]
        ends = np.cumsum(taken)
        out = ids[np.repeat((np.cumsum(length) - length)[place] - (ends - taken), taken) + np.arange(ends[-1])]
        limits = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        return [out[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]

    def forget(self) -> None:
        """Let go of the words learnt; the tokenizer stays."""
        self.spaced, self.bare = {}, {}
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks


def _strings(words: pa.Array) -> list[str]:
    """``to_pylist`` by way of one long string."""
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")
    return joined if len(joined) == len(words) else words.to_pylist()  # a word of an irregular text may hold a line break


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts in order, what stands before each, and how many each text has."""
    regular = [bool(t) and not _irregular(t) for t in texts]
    lines = pa.compute.split_pattern(pa.array([t if ok else "" for t, ok in zip(texts, regular)], pa.string()), "\n")
    words = pa.compute.split_pattern(lines.flatten(), " ")
    at_line, at_word = np.asarray(lines.offsets), np.asarray(words.offsets)
    kinds = np.full(at_word[-1], _SPACED)
    kinds[at_word[:-1]] = _BROKEN
    bounds = at_word[at_line].tolist()  # first words of the texts
    kinds[bounds[:-1]] = _FIRST
    flat, sizes = words.flatten(), np.diff(bounds)
    if all(regular):
        return flat, kinds, sizes
    pieces, marks, at = [], [], 0
    for k, (text, ok) in enumerate(zip(texts, regular)):  # a text that is not regular has one empty word so far
        if ok:
            continue
        own = _SAFE.split(text) if text else []
        pieces += [flat[at : bounds[k]], pa.array(own[::2], flat.type)]
        marks += [kinds[at : bounds[k]], np.array([_FIRST, *[_SPACED if x == " " else _BROKEN for x in own[1::2]]][: len(own[::2])], kinds.dtype)]
        sizes[k], at = len(own[::2]), bounds[k] + 1
    return pa.concat_arrays([*pieces, flat[at:]]), np.concatenate([*marks, kinds[at:]]), sizes


@cache
def encoder(path: str) -> Encoder:
    """The Python worker's tokenizer; of the words it learns at most ``CACHED_WORDS`` of a kind stay (about 20 MB), till the task's end."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks use the cores
    return Encoder(path)


@dataclass(frozen=True)
class Dictionary:
    content: bytes

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.content).hexdigest()

    def _zstd(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.content) if self.content else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._zstd())

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._zstd())


def train_dictionary(texts: DataFrame, path: str) -> Dictionary:
    """From a sample of about ``SAMPLE_DOCS`` different texts, by hash; too few samples for training serve as they are."""
    rows = texts.count()
    if not rows:
        return Dictionary(b"")
    part = F.pmod(F.xxhash64("_text"), F.lit(1 << 30))
    sample = texts.where(part < int((1 << 30) * min(1.0, SAMPLE_DOCS / rows))) if rows > SAMPLE_DOCS else texts
    sample = sample.dropDuplicates(["_text"])  # copies come together before the shuffle: a text that fills the table is one sample

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in slices(batches, "_text", SLICE_BYTES):
                ids = own.encode([t or "" for t in batch.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in ids], pa.binary())], ["ids"])
        finally:
            own.forget()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(x for b in batches for x in b.column("ids").to_pylist())
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            content = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    made = sample.mapInArrow(serialised, "ids binary").repartition(1).mapInArrow(train, "content binary").first()
    return Dictionary(bytes(made["content"]) if made else b"")


def _framed(path: str, end_id: int, dictionary: Dictionary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = dictionary.compressor()
        own = encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        try:
            for batch in slices(batches, "_text", SLICE_BYTES):
                ids = [x + end for x in own.encode([t or "" for t in batch.column("_text").to_pylist()])]
                sizes, frames = pa.array([len(x) // own.dtype.itemsize for x in ids], pa.int64()), pa.array([zstd.compress(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), sizes, frames], ["id", "n_tokens", "frame"])
        finally:
            own.forget()

    return run


def _packed(index_type: pa.DataType, digest: str, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, width = TaskContext.get().partitionId(), encoder(path).dtype.itemsize  # the driver loads no tokenizer
        index, frames, at, tokens, block = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            values = [[shard], [block], [digest], [width], [index], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(index_type), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["shard", "block", "dictionary", "width", "index", "payload"])

        for batch in batches:
            for doc, n, frame in zip(*(batch.column(k).to_pylist() for k in ("id", "n_tokens", "frame"))):
                if index and (at + len(frame) > BLOCK_BYTES or len(index) >= BLOCK_DOCS):
                    yield close()
                    index, frames, at, block = [], [], 0, block + 1
                index.append({"doc_id": doc, "offset": at, "length": len(frame), "n_tokens": n, "before": tokens})
                frames.append(frame)
                at, tokens = at + len(frame), tokens + n
        if index:
            yield close()

    return run


def write(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, Dictionary]:
    """Encode and write; gives the folder (of blocks, and of the dictionary) and the dictionary."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "token-files")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    dictionary = train_dictionary(own.select("_text"), path)
    kind = own.schema["_id"].dataType.simpleString()
    frames = persist_table(own.mapInArrow(_framed(path, end_id, dictionary), f"id {kind}, n_tokens bigint, frame binary"), "frames")
    fields = f"doc_id {kind}, offset int, length int, n_tokens bigint, before bigint"
    arrow_id = pa.schema(own.select("_id").limit(0).toArrow().schema).field("_id").type
    index_type = pa.struct([("doc_id", arrow_id), ("offset", pa.int32()), ("length", pa.int32()), ("n_tokens", pa.int64()), ("before", pa.int64())])
    # rows that share an id, or have none, are dealt by frame and place, as they may be a third of the table
    spread = frames.withColumn("_hash", F.xxhash64("frame")).withColumn("_row", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange("id", "_hash", "_row").sortWithinPartitions("id", "_hash", "_row").drop("_hash", "_row")
    blocks = ordered.mapInArrow(_packed(index_type, dictionary.sha256, path),
                                f"shard int, block int, dictionary string, width int, index array<struct<{fields}>>, payload binary")
    blocks.write.options(**_BLOCK_FILES).parquet(f"{folder}/blocks")
    # a frame of literals: one made from a local list starts a second set of Python workers, which stay
    stored = spark.range(1, numPartitions=1).select(F.lit(dictionary.sha256).alias("sha256"), F.lit(bytearray(dictionary.content)).alias("content"))
    stored.write.parquet(f"{folder}/dictionary")
    return folder, dictionary


def read_dictionary(spark: SparkSession, folder: str) -> Dictionary:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = Dictionary(bytes(row["content"]))
    if dictionary.sha256 != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document: ``doc_id, start, n_tokens, ids_crc32`` and, with ``with_ids``, ``ids``."""
    small_batches(spark)
    dictionary = read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("index", F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"])).alias("n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kind = blocks.schema["index"].dataType.elementType["doc_id"].dataType.simpleString()
    placed = blocks.join(small_side(bases), "shard").select("base", "dictionary", "width", "index", "payload")
    columns = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return placed.mapInArrow(_unpacked(dictionary, with_ids), columns)


def _unpacked(dictionary: Dictionary, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, digest = dictionary.decompressor(), dictionary.sha256
        for batch in batches:
            for k in range(batch.num_rows):
                base, used, width, payload = (batch.column(c)[k].as_py() for c in ("base", "dictionary", "width", "payload"))
                if used != digest:
                    raise ValueError("a block was written with another dictionary")
                entries = batch.column("index")[k].values
                found, view = [], memoryview(payload)
                for offset, length, n in zip(*(entries.field(c).to_pylist() for c in ("offset", "length", "n_tokens"))):
                    ids = np.frombuffer(zstd.decompress(view[offset : offset + length]), f"<u{width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a frame does not hold the ids that its index says")
                    found.append(ids)
                out = [entries.field("doc_id"), pa.compute.add(entries.field("before"), base), entries.field("n_tokens"), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return run


def read_document(spark: SparkSession, folder: str, doc_id) -> list[int] | None:
    """The ids of one document, from its own frame only."""
    dictionary = read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").select("width", "payload", F.explode("index").alias("at")).where(F.col("at.doc_id") == doc_id)
    row = blocks.select("width", F.expr("substring(payload, at.offset + 1, at.length)").alias("frame")).first()
    if row is None:
        return None
    return np.frombuffer(dictionary.decompressor().decompress(bytes(row["frame"])), f"<u{row['width']}").tolist()
