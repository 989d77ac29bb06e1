"""Personal data: patterns, and a skip-chain conditional random field that carries their labels on.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The field's nodes are a document's tokens
(runs without ASCII white space, edge marks cut off) that hold a digit or an @; tokens without are never
labelled. Neighbours at most ``NEAR`` characters apart share a chain potential; tokens with the same key (letters
and digits in lower case, the part before an @, or seven digits and more) share skip potentials, however far: two
by an edge, more through one shared node, whose potential is the square root of the edge's (a pair joined through
it is as if joined by the edge), so evidence at one mention reaches all others alike. Mentions outside patterns
look alike, so their own evidence counts once at the shared node, not once for each. Weights are trained in numpy by pseudo-likelihood on a bounded sample of
documents (``TRAIN_DOCS`` at most, picked by a hash of id and text, the first ``TRAIN_CHARS`` characters of each), with the patterns as labels and the pattern features hidden from a third of
the nodes; skip potentials are drawn towards ``AGREE`` for equal labels, as few samples hold repeats. Loopy message passing gives each node's marginals; a message is sent again until no message before it
moves by ``STILL`` (``SETTLE`` rounds and ``PER_LINK`` more for each node of the longest chain at most). A node outside all pattern spans whose
label reaches ``SURE`` becomes a span. Pattern spans are never changed.

Texts are whole; null and empty ones have no span. Every row is judged by itself, so repeated rows and
ids get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import flat, slices

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, ROUNDS, STEP, DECAY, NEAR, SURE, SEED, AGREE = 4000, 300, 0.5, 1e-4, 40, 0.9, 31, 4.0
TRAIN_CHARS = 32_768
STILL, SETTLE, PER_LINK = 1e-4, 200, 4

# The patterns that define the base spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'"
_DIGIT = re.compile(r"[^0-9]")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind, then start."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# --- the field ---------------------------------------------------------------------------

LABELS = 1 + len(KINDS)  # 0: none
_SHAPES = 18
FEATURES = _SHAPES + len(KINDS)


class Graph:
    """Nodes and edges of some documents."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.labels: list[int] = []
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []  # of keys with two mentions
        self.repeats: list[tuple[int, int]] = []  # next mentions, of keys with more
        self.shared: list[list[int]] = []  # their mentions
        self.longest = 0  # nodes in a row that are joined by chain edges

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        before, mentions, linked = None, {}, 0
        ordered = sorted(base, key=lambda s: s[1])
        at = 0
        for m in _TOKEN.finditer(text):
            token = m[0]
            if not ("@" in token or any("0" <= c <= "9" for c in token)):
                continue
            start = m.start() + len(token) - len(token.lstrip(_EDGE))
            token = token.strip(_EDGE)
            end = start + len(token)
            while at < len(ordered) and ordered[at][2] <= start:
                at += 1
            covers = [kind for kind, a, b in ordered[at : at + 4] if a < end and b > start]
            node = len(self.labels)
            self.labels.append(1 + covers[0] if covers else 0)
            self.features.append(_shape(token, text[m.start()]) + [int(k in covers) for k in range(len(KINDS))])
            self.spans.append((doc, start, end))
            if before is not None and start - before[1] <= NEAR:
                self.chain.append((before[0], node))
                linked += 1
            else:
                linked = 1
            self.longest = max(self.longest, linked)
            before = (node, end)
            for key in _keys(token):
                mentions.setdefault(key, []).append(node)
        for nodes in mentions.values():
            (self.skip if len(nodes) == 2 else self.repeats).extend(zip(nodes, nodes[1:]))
            if len(nodes) > 2:
                self.shared.append(nodes)


def _shape(token: str, first: str) -> list[int]:
    digits = sum("0" <= c <= "9" for c in token)
    size = (0, 1, 3, 5, 7, 9, 13, 16, 20)
    bucket = sum(digits >= s for s in size[1:])
    return [1, *(int(bucket == k) for k in range(len(size))), int("@" in token), int(token.count(".") == 3), int("-" in token), int(first == "+"), int(first == "("),
            int(digits == len(token)), int(any(c.isalpha() for c in token)), int("." in token)]


def _keys(token: str) -> set[str]:
    out = {re.sub(r"[\W_]", "", part.lower()) for part in (token, token.split("@")[0])}
    digits = _DIGIT.sub("", token)
    return {k for k in out if len(k) >= 4} | ({digits} if len(digits) >= 7 else set())


def _arrays(graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(graph.labels)
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip)]
    return np.array(graph.features, np.float64).reshape(n, FEATURES), np.array(graph.labels, np.int64), *pairs


def train(graph: Graph) -> np.ndarray:
    """Rows of weights: features, chain potentials, skip potentials; the last two are made symmetric."""
    x, y, chain, skip = _arrays(graph)
    skip = np.concatenate([skip, np.array(graph.repeats, np.int64).reshape(-1, 2)])
    prior = np.vstack([np.zeros((FEATURES + LABELS, LABELS)), AGREE * np.eye(LABELS)])
    if not len(y):
        return prior
    own = np.eye(LABELS)[y]
    around = [np.zeros((len(y), LABELS)) for _ in range(2)]
    for total, edges in zip(around, (chain, skip)):
        np.add.at(total, edges[:, 0], own[edges[:, 1]])
        np.add.at(total, edges[:, 1], own[edges[:, 0]])
    hidden = np.random.default_rng(SEED).random(len(y)) < 1 / 3
    x = x.copy()
    x[hidden, _SHAPES:] = 0
    inputs = np.hstack([x, *around])
    weights, speed = prior.copy(), np.zeros_like(prior)
    for _ in range(ROUNDS):
        scores = inputs @ weights
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + inputs.T @ (own - chance) / len(y) - DECAY * (weights - prior)
        weights += STEP * speed
    for at in (FEATURES, FEATURES + LABELS):
        part = weights[at : at + LABELS]
        weights[at : at + LABELS] = (part + part.T) / 2
    return weights


def _root(potential: np.ndarray) -> np.ndarray:
    """What gives ``potential`` when two edges with it meet in a shared node."""
    values, vectors = np.linalg.eigh(potential)
    root = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    return np.maximum(root, 1e-6 * root.max())


def marginals(graph: Graph, weights: np.ndarray) -> np.ndarray:
    """Loopy sum-product over all documents' edges at once; every edge's potential is symmetric."""
    x, y, chain, skip = _arrays(graph)
    n = len(x)
    if not n:
        return np.zeros((0, LABELS))
    total = np.vstack([x @ weights[:FEATURES], np.zeros((len(graph.shared), LABELS))])
    sizes = [len(nodes) for nodes in graph.shared]
    hub = np.stack([np.array([node for nodes in graph.shared for node in nodes], np.int64), n + np.repeat(np.arange(len(sizes)), sizes)], axis=1)
    alike = np.bincount(hub[:, 1] - n, y[hub[:, 0]] == 0, minlength=len(sizes))[hub[:, 1] - n]
    edges = np.concatenate([chain, skip, hub])
    begin, end = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    half = len(edges)
    back = np.concatenate([np.arange(half) + half, np.arange(half)])
    potentials = np.exp(weights[FEATURES:]).reshape(2, LABELS, LABELS)
    potentials = np.stack([*potentials, _root(potentials[1])])
    kind = np.tile(np.repeat([0, 1, 2], [len(chain), len(skip), len(hub)]), 2)
    force = np.ones(2 * half)  # of the messages
    force[len(chain) + len(skip) : half] = np.where(y[hub[:, 0]] == 0, 1 / np.maximum(alike, 1), 1)
    messages = np.zeros((2 * half, LABELS))
    active = np.arange(2 * half)
    for _ in range(SETTLE + PER_LINK * graph.longest):
        if not len(active):
            break
        sent = total[begin[active]] - messages[back[active]]
        sent = np.exp(sent - sent.max(axis=1, keepdims=True))
        fresh = np.empty_like(sent)
        for k in range(3):
            own = kind[active] == k
            fresh[own] = sent[own] @ potentials[k]
        fresh = np.log(fresh / fresh.sum(axis=1, keepdims=True)) * force[active, None]
        step = (fresh - messages[active]) / 2  # damped, as loops may swing
        messages[active] += step
        np.add.at(total, end[active], step)
        moves = np.abs(step).max(axis=1) >= STILL
        moved = np.zeros(len(total), bool)
        moved[end[active[moves]]] = True
        again = moved[begin]
        again[active[moves]] = True
        active = np.flatnonzero(again)
    total = np.exp(total[:n] - total[:n].max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


# --- on Spark -----------------------------------------------------------------------------

_EVIDENCE = np.zeros(256, np.int64)
_EVIDENCE[[*range(48, 58), ord("@")]] = 1


def _texts(column: pa.Array) -> list[tuple[int, str]]:
    """Rows that hold a digit or an @ (in the others there is nothing to find)."""
    data, offsets = flat(column)
    sums = np.append(0, np.cumsum(_EVIDENCE[data]))[offsets]
    return [(i, column[i].as_py()) for i in np.flatnonzero(np.diff(sums)).tolist()]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph = Graph()
    for text in sorted(t for batch in batches for t in batch.column("_text").to_pylist()):
        graph.add(0, text, base_spans(text))
    yield pa.RecordBatch.from_arrays([pa.array([train(graph).ravel()], pa.list_(pa.float64()))], ["weights"])


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TRAIN_DOCS) -> DataFrame:
    """``_text`` of at most ``sample`` rows with a digit or an @; copies of a text are picked one by one."""
    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    texts = docs.select(part.alias("_part"), F.substring(F.col(text_col), 1, TRAIN_CHARS).alias("_text")).where(F.col(text_col).rlike("[0-9@]"))
    rows = texts.count()
    # Twice the share, so that the limit is reached; it holds too where many rows have one id and text.
    some = texts.where(F.col("_part") < int((1 << 30) * 2 * sample / rows)) if rows > 2 * sample else texts
    return some.orderBy("_part", "_text").limit(sample).select("_text")


def fit(docs: DataFrame, text_col: str = "text", sample: int = TRAIN_DOCS, id_col: str = "doc_id") -> np.ndarray:
    """Weights, trained in one task on a sample of at most ``sample`` texts with a digit or an @."""
    some = sampled(docs, id_col, text_col, sample)
    row = some.repartition(1).mapInArrow(_trained, "weights array<double>").first()
    return np.array(row["weights"]).reshape(-1, LABELS) if row else train(Graph())


def _found(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            base: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            more: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            graph = Graph()
            for row, text in _texts(batch.column("_text")):
                base[row] = base_spans(text)
                graph.add(row, text, base[row])
            chance = marginals(graph, weights)
            for node in np.flatnonzero((chance[:, 1:].max(axis=1, initial=0) >= SURE) & (np.array(graph.labels) == 0) if len(chance) else []):
                row, start, end = graph.spans[node]
                more[row].append((int(chance[node, 1:].argmax()), start, end))
            listed = [[{"kind": KINDS[k], "start": a, "end": b, "base": s in base[i]} for s in sorted(base[i] + more[i]) for k, a, b in [s]] for i in range(batch.num_rows)]
            spans = pa.array(listed, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))
            texts = [[",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found)) for found in lists] for lists in (base, [x + y for x, y in zip(base, more)])]
            counts = [pa.array([sum(s[0] == k for s in found) for found in base], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts[0]])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *counts, digests, pa.array(texts[1]), spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``found``, the spans as structs."""
    weights = fit(docs, text_col, id_col=id_col) if weights is None else weights
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    kind = own.schema["_id"].dataType.simpleString()
    return own.mapInArrow(_found(weights), f"doc_id {kind}, {counts}, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,base:boolean>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
