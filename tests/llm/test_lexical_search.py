"""Ranked search against scores of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import lexical_search
from codeloom.session import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, own in asked.items():
        found = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank] = (None if null else i, -score)
    return out


def got(frame):
    rows = frame.collect()
    found = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("shard, block_terms", [(8192, 250_000), (7, 300)])
def test_against_all_documents(spark, shard, block_terms):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(lexical_search.search(docs, items, shard=shard, block_terms=block_terms)) == want


def test_long_lists_are_skipped_without_loss(monkeypatch):
    """Few and many documents, short runs, all splits into short and long lists."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(lexical_search, "RUN", 16)
    for short in (0.0, 0.3, 5.0):
        monkeypatch.setattr(lexical_search, "SHORT", short)
        for trial in range(20):
            n, n_terms = int(rng.integers(1, 300)), int(rng.integers(1, 12))
            dense = rng.integers(0, 50, (n, n_terms)) * (rng.random((n, n_terms)) < rng.random(n_terms)) * rng.integers(1, 40, n_terms)
            best = lexical_search.Best(5)
            for a, b in ((0, n // 2), (n // 2, n)):
                docs, places = np.nonzero(dense[a:b])
                lexical_search.Shard(np.arange(a, b), places, docs, dense[a:b][docs, places]).search(np.arange(n_terms), best)
            score = dense.sum(axis=1)
            order = [i for i in np.lexsort((np.arange(n), -score))[:5] if score[i] > 0]
            assert best.ids.tolist() == order and best.scores.tolist() == score[order].tolist()


DOCS = "doc_id long, text string, id long, n long, m long, terms string, tfs string, term string, item_id long, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "a", "b", "c", 4, 5) for i, t in rows], DOCS)


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 5003} The" for i in range(80_000))
    docs = [(1, "The cat sat"), (2, None), (3, ""), (4, " \n-"), (5, "the CAT"), (5, "the CAT"), (None, "cat cat cat"), (None, None), (6, long), (7, "ÄÖ ä-ö İ the"), (9, "cat_sat"), (8, "cat_sat")]
    docs += [(100 + i, "the same text") for i in range(200)]
    items = [(1, "cat THE"), (1, "sat"), (2, None), (3, "nowhere"), (None, "cat"), (4, "Ä ö w17 the"), (5, "same " * 50), (6, "")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    assert got(lexical_search.search(frame(spark, docs), asked, shard=50)) == plain(docs, items)
    assert lexical_search.search(frame(spark, []), asked).count() == 0
    assert lexical_search.search(frame(spark, docs), asked.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None), (2, "-")]), asked).count() == 0
