"""Licence scan: sparse logistic regression over word n-grams of paragraphs, confirmed by templates.

A paragraph is what stands between lines without words, so a notice may be wrapped anywhere (comment marks are no words).
Each of its lines is judged by itself, and all its words once more over the line breaks. What has more than ``WINDOW`` words
is read in windows of that many words that overlap by half, so every part of every text is judged. A family found in
a part takes the place of unknown licences in parts that share a line with it, and an unknown licence in a line that of
one over several lines; of two families confirmed by mostly the same words, the one confirmed further stays. Words are runs of ASCII letters and digits, in lower case.
Features are the words and word pairs that occur in the templates, and the share of words that occur in none. The
classifier knows every family and "none"; it is trained in numpy on variations of the templates (with other
words before and after, words left out, mixed families) and on a bounded sample of paragraphs of the corpus
(``NEGATIVES``, picked by hash) that share few pairs with any template. Probabilities are calibrated by temperature on held-out
variations. A prediction of a family counts if its probability reaches ``SURE`` and one phrase of the family's templates
is found with at least ``CONTAINED`` of its word pairs (of families confirmed by mostly the same words, as LGPL and GPL, it is
the one confirmed furthest, with the probabilities of those confirmed less); with ``TRACE`` of them it is an unknown licence, with less none.

Null and empty texts have no paragraph and no licence. Every row is judged by itself, so repeated rows get equal
results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import ASCII_LOWER, flat, hash_runs, runs, slices

WINDOW, NEGATIVES, ROUNDS, STEP, DECAY, SURE, CONTAINED, TRACE, SEED = 40, 20_000, 400, 2.0, 1e-4, 0.8, 0.7, 0.3, 37

# How each family is named or granted in notices. The first words of a family are its name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0 january 2004"),
    "MIT": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "BSD": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "released under the bsd license"),
    "GPL-3.0": ("licensed under the gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3"),
    "GPL-2.0": ("licensed under the gnu general public license version 2", "gnu general public license as published by the free software foundation either version 2"),
    "LGPL": ("licensed under the gnu lesser general public license", "gnu lesser general public license as published by the free software foundation"),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license as published by the free software foundation"),
    "MPL-2.0": ("licensed under the mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "CC-BY-4.0": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CC0-1.0": ("dedicated to the public domain under cc0 1 0", "cc0 1 0 universal public domain dedication"),
    "Proprietary": ("all rights reserved no part of this work may be reproduced", "proprietary and confidential all rights reserved", "all rights reserved"),
}
FAMILIES = tuple(TEMPLATES)
NONE = len(FAMILIES)
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def _hashes(text: str) -> np.ndarray:
    data, offsets = flat(pa.array([text]))
    begins, ends, _ = runs(ASCII_LOWER[data], offsets, _WORD)
    return hash_runs(ASCII_LOWER[data], begins, ends)


def _pairs(words: np.ndarray) -> np.ndarray:
    return words[:-1] * np.uint64(3) + words[1:] * np.uint64(7)


PHRASES = [(k, _hashes(phrase)) for k, family in enumerate(FAMILIES) for phrase in TEMPLATES[family]]
VOCABULARY = np.unique(np.concatenate([x for _, words in PHRASES for x in (words, _pairs(words))]))
WIDTH = len(VOCABULARY) + 2  # and the share of other words, and 1


def features(words: np.ndarray) -> np.ndarray:
    """Of one paragraph: which n-grams of the templates it holds, scaled to length 1."""
    grams = np.concatenate([words, _pairs(words)])
    place = np.minimum(np.searchsorted(VOCABULARY, grams), len(VOCABULARY) - 1)
    known = VOCABULARY[place] == grams
    out = np.zeros(WIDTH)
    out[place[known]] = 1
    out /= max(1.0, np.sqrt(out.sum()))
    out[-2], out[-1] = 1 - known[: len(words)].mean() if len(words) else 1, 1
    return out


def contained(words: np.ndarray, family: int) -> tuple[float, frozenset[int]]:
    """The largest share of a phrase's word pairs, among the family's phrases, that the paragraph holds, and where it does."""
    mine = _pairs(words)
    share, phrase = max(((np.isin(_pairs(phrase), mine).mean(), phrase) for k, phrase in PHRASES if k == family), key=lambda x: x[0])
    return float(share), frozenset(np.flatnonzero(np.isin(mine, _pairs(phrase))).tolist())


def alike(a: frozenset[int], b: frozenset[int]) -> bool:
    """Whether most of the word pairs of one match are in the other."""
    return bool(a) and bool(b) and 2 * len(a & b) >= min(len(a), len(b))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # WIDTH x classes
    temperature: float
    accuracy: float = field(default=float("nan"))  # on held-out variations

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        scores = rows @ self.weights / self.temperature
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        return chance / chance.sum(axis=1, keepdims=True)


def _variations(rng: np.random.Generator, others: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Template phrases within other words, some words left out; and phrases of mixed words, of no family."""
    rows, labels = [], []
    pick = lambda n: rng.choice(others, n)
    for k, phrase in PHRASES:
        for _ in range(each):
            kept = phrase[rng.random(len(phrase)) > 0.05]
            rows.append(features(np.concatenate([pick(rng.integers(0, 12)), kept, pick(rng.integers(0, 12))])))
            labels.append(k)
    everything = np.concatenate([words for _, words in PHRASES])
    for _ in range(each * len(PHRASES)):
        rows.append(features(np.concatenate([pick(rng.integers(3, 30)), rng.choice(everything, rng.integers(0, 4))])))
        labels.append(NONE)
    return np.array(rows), np.array(labels)


def train(negatives: list[np.ndarray], seed: int = SEED) -> Model:
    """``negatives``: words of paragraphs of no family."""
    rng = np.random.default_rng(seed)
    others = np.unique(np.concatenate([*negatives, np.arange(1, 200, dtype=np.uint64)]))
    x, y = _variations(rng, others, 40)
    if negatives:
        x, y = np.vstack([x, [features(n) for n in negatives]]), np.append(y, np.full(len(negatives), NONE))
    share = np.bincount(y, minlength=NONE + 1)[y]
    weigh = (1 / share / (NONE + 1))[:, None]  # every class counts alike
    weights, speed, goal = np.zeros((WIDTH, NONE + 1)), np.zeros((WIDTH, NONE + 1)), np.eye(NONE + 1)[y]
    for _ in range(ROUNDS):
        speed = 0.9 * speed + x.T @ (weigh * (goal - Model(weights, 1.0).probabilities(x))) - DECAY * weights
        weights = weights + STEP * speed
    held, truth = _variations(rng, others, 20)
    losses = {t: -np.log(Model(weights, t).probabilities(held)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    best = min(losses, key=losses.get)
    model = Model(weights, best)
    return Model(weights, best, float((model.probabilities(held).argmax(axis=1) == truth).mean()))


def judge(model: Model, paragraphs: list[np.ndarray]) -> list[tuple[int, float, float, frozenset[int]]]:
    """Family (NONE for none, -1 for unknown), probability, how far the templates confirm it, and by which word pairs."""
    if not paragraphs:
        return []
    chance = model.probabilities(np.array([features(p) for p in paragraphs]))
    out = []
    for words, row in zip(paragraphs, chance):
        k = int(row.argmax())
        if k == NONE:
            out.append((NONE, float(row[k]), 0.0, frozenset()))
            continue
        all_found = [contained(words, j) for j in range(NONE)]
        same = [j for j in range(NONE) if j == k or alike(all_found[j][1], all_found[k][1])]
        k = max(same, key=lambda j: (all_found[j][0], j == k))
        found, places = all_found[k]
        sum_of = float(row[k] + sum(row[j] for j in same if all_found[j][0] < found))
        sure = sum_of >= SURE and found >= CONTAINED
        out.append((k if sure else -1 if found >= TRACE else NONE, sum_of, found, places))
    return out


def paragraphs(column: pa.Array) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Row, first line, last line, number of the window, place of its first word and words, of those that hold two words or more of the templates.

    The others hold no pair of the templates, so nothing could confirm a family for them.
    """
    data, offsets = flat(column)
    data = ASCII_LOWER[data]
    begins, ends, first = runs(data, offsets, _WORD)
    hashes = hash_runs(data, begins, ends)
    if not len(hashes):
        return
    known = np.isin(hashes, VOCABULARY)
    breaks = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    line = np.searchsorted(breaks, begins) - np.searchsorted(breaks, offsets)[row]
    sums = np.append(0, np.cumsum(known))
    other, step = row[1:] != row[:-1], np.diff(line)
    for wrapped, cut in ((False, other | (step != 0)), (True, other | (step > 1))):
        cuts = np.flatnonzero(cut) + 1
        starts, stops = np.append(0, cuts), np.append(cuts, len(hashes))
        for k in np.flatnonzero(sums[stops] - sums[starts] >= 2).tolist():
            a, b = int(starts[k]), int(stops[k])
            places = [a] if b - a <= WINDOW else [*range(a, b - WINDOW // 2, WINDOW // 2)]
            for w, at in enumerate(places):
                end = min(at + WINDOW, b)
                if sums[end] - sums[at] >= 2 and not (wrapped and line[at] == line[end - 1]):
                    yield int(row[at]), int(line[at]), int(line[end - 1]), w, at, hashes[at:end]


def settled(found: list[dict]) -> list[dict]:
    """Of one row, in order: families, and unknown licences whose lines hold no family, nor an unknown licence of one line if they are several.

    Of two families confirmed by mostly the same words (one from a part that begins or ends inside the notice), the one confirmed further stays.
    """
    families = sorted((f for f in found if f["family"] != "unknown"), key=lambda f: min(f["places"]))
    lost = set()
    for i, f in enumerate(families):
        for g in itertools.takewhile(lambda g: min(g["places"]) < min(f["places"]) + WINDOW, itertools.islice(families, i + 1, None)):
            if f["family"] != g["family"] and f["contained"] != g["contained"] and alike(f["places"], g["places"]):
                lost.add(id(min(f, g, key=lambda x: x["contained"])))
    found = [f for f in found if id(f) not in lost]
    sure = {line for f in found if f["family"] != "unknown" for line in range(f["line"], f["last"] + 1)}
    single = {f["line"] for f in found if f["line"] == f["last"]}
    keep = lambda f: f["family"] != "unknown" or not any(n in sure or (f["line"] < f["last"] and n in single) for n in range(f["line"], f["last"] + 1))
    return sorted(filter(keep, found), key=lambda f: (f["line"], f["last"], f["window"]))


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_line"):
        data, offsets = flat(batch.column("_line"))
        data = ASCII_LOWER[data]
        begins, ends, first = runs(data, offsets, _WORD)
        hashes = hash_runs(data, begins, ends)
        lines = [hashes[a : min(b, a + WINDOW)] for a, b in zip(first[:-1], first[1:]) if b > a]
        pairs = VOCABULARY
        lines = [x for x in lines if np.isin(_pairs(x), pairs).sum() <= 1]
        yield pa.RecordBatch.from_arrays([pa.array([x.view(np.int64) for x in lines], pa.list_(pa.int64()))], ["words"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = sorted((tuple(x) for b in batches for x in b.column("words").to_pylist()))
    model = train([np.array(x, np.int64).view(np.uint64) for x in lists])
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.ravel()], pa.list_(pa.float64())), pa.array([model.temperature]), pa.array([model.accuracy])], ["weights", "temperature", "accuracy"])


def fit(docs: DataFrame, text_col: str = "text", sample: int = NEGATIVES) -> Model:
    """Trained in one task, with about ``sample`` lines of the corpus among the negatives."""
    rows = docs.count()
    part = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 30))
    some = docs.where(part < int((1 << 30) * (sample / 8) / rows)) if rows > sample / 8 else docs
    lines = some.select(F.explode(F.split(F.col(text_col), "\n")).alias("_line"))
    row = lines.mapInArrow(_negatives, "words array<bigint>").orderBy(F.xxhash64("words")).limit(sample).repartition(1)
    row = row.mapInArrow(_trained, "weights array<double>, temperature double, accuracy double").first()
    return Model(np.array(row["weights"]).reshape(WIDTH, NONE + 1), row["temperature"], row["accuracy"]) if row else train([])


def _scanned(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("line", pa.int32()), ("last", pa.int32()), ("window", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            parts = list(paragraphs(batch.column("_text")))
            for (row, line, last, window, at, _), (family, chance, share, places) in zip(parts, judge(model, [p[-1] for p in parts])):
                if family != NONE:
                    found[row].append({"line": line, "last": last, "window": window, "family": FAMILIES[family] if family >= 0 else "unknown", "probability": chance, "contained": share, "places": frozenset(at + p for p in places)})
            found = [[{k: v for k, v in f.items() if k != "places"} for f in settled(rows)] for rows in found]
            families = [",".join(sorted({f["family"] for f in rows} - {"unknown"})) for rows in found]
            unknown = pa.array([sum(f["family"] == "unknown" for f in rows) for rows in found], pa.int64())
            digests = pa.array([hashlib.md5(",".join(f"{f['line']}:{f['window']}:{f['family']}" for f in rows).encode()).hexdigest() for rows in found])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(families), unknown, digests, pa.array(found, kind)], ["doc_id", "families", "n_unknown", "notices_md5", "notices"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: ``doc_id, families`` (comma-joined), ``n_unknown, notices_md5`` and ``notices`` (line, last line, window, family, probability, contained)."""
    model = model or fit(docs, text_col)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(_scanned(model), f"doc_id {kind}, families string, n_unknown bigint, notices_md5 string, notices array<struct<line:int,last:int,window:int,family:string,probability:double,contained:double>>")
