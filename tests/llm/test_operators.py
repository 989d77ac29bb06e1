"""Operators against plain versions, and on awkward tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import common, decontaminate, licences, line_dedup, maxscore, mixing, near_dups, pii_crf, pseudo_likelihood, resampling, token_files, word_network
from codeloom.session import persist_table, table

SF = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key long, _text long, kept string, node long, _gone long, _spans string, _bad string, doc string, _whole string, copies long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [(1, long), (2, None), (3, ""), (4, " \n\t"), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "A b c\nd e f g"), (None, None),
             (7, "call +1 (375) 555-4393 or me@x.org"), (8, "one"), (9, long + " end")]
    return spark.createDataFrame([(i, t, None, [None, "s", "é"][k % 3], None, "x", 1, 2, "y", 3, 4, "s", "b", "d", "w", 5) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows, percent):
    sets = {i: plain_shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_words_as_numbers():
    column = pa.array(["The  cat\nsat", None, "", "cat the", "é Éa"])
    hashes, first = common.words(column)
    assert first.tolist() == [0, 3, 3, 3, 5, 7]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 5


def test_near_duplicates_against_all_pairs(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for percent in (80, 85):
        got = near_dups.near_duplicates(docs, percent=percent).collect()
        want = plain_components(rows, percent)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(plain_shingles(t)) for i, t in rows}


def test_dense_group_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 9)):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows, 85)


def test_components_end_with_stars(spark):
    rng = np.random.default_rng(9)
    for links in ([(1, 0), (3, 2)], [(k + 1, k) for k in range(40)], rng.integers(0, 300, (250, 2)).tolist()):
        top = {x: x for link in links for x in link}
        for _ in top:
            for x, y in links:
                top[x] = top[y] = min(top[x], top[y])
        got = near_dups.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["comp"] for r in got} == {x: y for x, y in top.items() if x != y}


def test_rounds_without_links_join_nothing(spark, monkeypatch):
    written, real = Counter(), near_dups.persist_table
    monkeypatch.setattr(near_dups, "persist_table", lambda df, name: (written.update([name]), real(df, name))[1])
    rows = [(k, " ".join(f"w{k // 2}_{i}" for i in range(99)) + " x" * (k % 2)) for k in range(20)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 2 for k in range(20)}
    assert written["small-star"] <= 3  # pairs are stars after a round; depths that find no link have none


def test_token_files_start_no_workers_for_the_dictionary(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *args, **more: made.append(args))
    folder, dictionary = token_files.write(docs.limit(20), TOKENS)
    assert not made and token_files.read_dictionary(spark, folder) == dictionary


def test_token_files_load_no_tokenizer_on_the_driver(docs, monkeypatch):
    loaded = []
    monkeypatch.setattr(token_files.Encoder, "__init__", lambda self, path: loaded.append(path))
    token_files.write(docs.limit(20), TOKENS)
    assert not loaded


def test_near_duplicates_awkward(awkward, empty):
    got = near_dups.near_duplicates(awkward).collect()
    assert len(got) == 12
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[9]["component_id"] == 1 and not by_id[9]["kept"]
    assert by_id[6]["component_id"] == 5 and by_id[2]["n_shingles"] == 0 and by_id[8]["n_shingles"] == 1
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True, True]
    assert near_dups.keep_one(awkward, near_dups.near_duplicates(awkward)).count() == 10
    assert near_dups.near_duplicates(empty).count() == 0


def test_lines_awkward(awkward, empty):
    found = line_dedup.find_repeats(awkward)
    repeats = {(r["doc"], r["line_no"]) for r in found.where("repeat").collect()}
    assert repeats == {(5, 0), (9, 0)}  # both follow an earlier line, the one without id standing first
    left = line_dedup.remove_repeats(awkward, found)
    assert left.columns == awkward.columns and left.count() == 12
    assert left.where("doc_id = 5").select("text").first()["text"] == ""
    assert line_dedup.find_repeats(empty).count() == 0


def test_mix(docs, awkward, empty):
    rows = mixing.mix(docs).collect()
    by_source = Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    aims, sizes = {}, {}
    for r in rows:
        by_source[source[r["doc_id"]]] += r["taken"]
        aims[source[r["doc_id"]]], sizes[source[r["doc_id"]]] = r["target"], r["source_size"]
        assert r["taken"] <= 2 * r["size"]
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted(aims)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free = {s for s in order if aims[s] < 2 * sizes[s] - 1e-6}
    assert len({round(aims[s] / weight[s], 6) for s in free}) <= 1  # the uncapped share by weight
    largest = Counter()
    for r in rows:
        largest[source[r["doc_id"]]] = max(largest[source[r["doc_id"]]], r["size"])
    assert all(abs(by_source[s] - aims[s]) <= largest[s] / 2 + 1 for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    copies = Counter(r["doc_id"] for r in mixing.repeat_documents(docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.mix(awkward).count() == 12 and mixing.mix(empty).count() == 0
    assert mixing.repeat_documents(awkward).columns == awkward.columns


@pytest.mark.parametrize("ids", ["none", "one", "hot"])
def test_mix_of_rows_in_one_place(spark, ids):
    """Rows without id, or with one id, and of one size: the mix takes so many that it comes near its target."""
    text = " ".join("abcdefghij")
    rows = [({"none": None, "one": 5}.get(ids, k if k % 3 else 7), text, "s") for k in range(100)] + [(1000 + k, f"{text} {k}", "t") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(frame, weights=(1, 1)).collect()
    for size, n in ((10, 100), (11, 30)):
        own = [r for r in mixed if r["size"] == size]
        assert len(own) == n and all(r["taken"] in (0, size, 2 * size) for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2 + 1e-6
    folder = persist_table(frame, "rows")
    copies = Counter((r["doc_id"], r["text"]) for r in mixing.repeat_documents(folder, weights=(1, 1)).collect())
    want = Counter()
    for r in mixed:
        want[r["doc_id"] if r["size"] == 10 else r["doc_id"], r["size"]] += r["copies"]
    got = Counter()
    for (i, t), n in copies.items():
        got[i, len(t.split())] += n
    assert got == +want


def test_token_files(spark, docs, awkward, empty):
    plain = Tokenizer.from_file(TOKENS)
    for frame in (docs, awkward):
        folder, dictionary = token_files.write(frame, TOKENS)
        got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda i: (i is not None, i))
        want = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in frame.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        start = 0
        for r in got:
            assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            start += r["n_tokens"]
    assert token_files.read_document(spark, folder, 8) == plain.encode("one").ids + [0]
    assert token_files.read_document(spark, folder, 12345) is None
    folder, _ = token_files.write(empty, TOKENS)
    assert token_files.read(spark, folder).count() == 0


def test_word_cache_is_exact():
    texts = ["", " ", "a", " a", "a ", "a\n\nb", "a  b", "don't we'll", "x <|endoftext|> y", "é è. ñ, ß!", "a 　b", "12 3.4 +1 (5)", "\x1c a \x1c", "a\tb", "日本 語.", "naïve.. test..", "A.B c.D"]
    plain = Tokenizer.from_file(TOKENS)
    got = token_files.Encoder(TOKENS).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_learnt_together_come_apart_rightly():
    rng = np.random.default_rng(3)
    parts = [*"ab  \n\n\t.,'1é日ß\x1c\u3000\u2028 \x85<|", "don't", "we'll", "<|endoftext|>", "Hello", "naïve", "\r\n", "...", "Ċ", "Ġ"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 30))) for _ in range(3000)]
    plain, own = Tokenizer.from_file(TOKENS), token_files.Encoder(TOKENS)
    got = [x for at in range(0, len(texts), 100) for x in own.encode(texts[at : at + 100])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_a_word_met_again_in_a_slice_is_looked_up_once(monkeypatch):
    own, looked = token_files.Encoder(TOKENS), []
    real = token_files.Encoder._looked_up
    monkeypatch.setattr(token_files.Encoder, "_looked_up", lambda self, words, *rest: looked.append(len(words)) or real(self, words, *rest))
    own.encode(["one two three\ntwo two"] * 500)
    assert looked == [2, 2]  # "one" and "two" without a space before them, "two" and "three" with one


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8 if i % 7 else 6)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(20)] + [(800, None), (900, [1.0, None]), (1000, [float("nan")]), (1100, [float("inf")]), (None, [1.0]), (5, rows[5][1])]
    rows += [(300, [5.0, 5.0]), (1200, []), (7, [5.0] * 8), (7, [4.0] * 8)]  # ids that repeat with other vectors, an empty vector
    got = maxscore.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("id", F.lit("x")).withColumn("score", F.lit(0)), F.col("id") % 100 == 0, shard=64).collect()
    clean = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, own) in enumerate(clean):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for n, (i, v) in enumerate(clean) if n != at)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    double = [r.vec_id for r in got if r.query_id == 300]
    assert len(double) == 20 and 300 in double
    huge = spark.createDataFrame([(0, [3e14, 1.0]), (1, [3e14, 2.0]), (2, [-3e14, 1.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in maxscore.search(huge, F.col("id") % 100 == 0).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]
    assert maxscore.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0


def test_resampling(spark, docs, awkward, empty):
    labels = table(spark, SF, "labels")
    rows = resampling.resample(docs, labels).collect()
    k = sum(r["kept"] for r in rows)
    assert {r["doc_id"] for r in sorted(rows, key=lambda r: -r["key"])[:k]} == {r["doc_id"] for r in rows if r["kept"]}
    assert resampling.keep_drawn(docs, resampling.resample(docs, labels)).count() == k
    assert resampling.resample(awkward, labels).count() == 12 and resampling.resample(empty, labels).count() == 0
    none = labels.where("false")
    assert resampling.resample(docs, none).where("kept").count() == docs.count()


def test_resampling_separates(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    shares = {r["quality"]: r["s"] for r in resampling.resample(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert shares[1] > 0.98 and shares[0] < 0.1


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 5)
    monkeypatch.setattr(resampling, "CELLS", 7)
    values = [float(x) for x in np.random.default_rng(1).normal(size=300)] + [0.25] * 40
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 170, 340):
        assert resampling.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_pseudo_likelihood(awkward, empty):
    rows = {r["doc_id"]: r for r in pseudo_likelihood.score(awkward).collect()}
    assert rows[2]["log_likelihood"] == 0 and rows[2]["mean_log_likelihood"] is None and rows[1]["n_words"] == 60_000
    assert pseudo_likelihood.score(empty).count() == 0


def test_words_from_context(spark):
    rng = np.random.default_rng(3)

    def text():  # 900 words in 300 chains: which word follows depends on the word before, not on any class of it
        return " ".join(f"{c}a {c}b {c}c" for c in (f"w{k}" for k in rng.integers(0, 300, 100)))

    def shuffled(t):
        return " ".join(rng.permutation(t.split()))

    train = spark.createDataFrame([(i, text()) for i in range(800)], "_id long, _text string").repartition(2).cache()
    counts = word_network.counted(train.select("_text"))
    known = word_network.modelled(counts)
    assert known.n == 900 and known.total == 240_000
    net = word_network.train(train.select("_text"), known, 2)
    held = [text() for _ in range(40)]

    def mean(some, n=net):
        hashes, first = common.words(pa.array(some))
        return word_network.log_chances(n, known.ids(hashes), first).mean()

    unigram = mean(held, word_network.Net.start(known))
    assert unigram == pytest.approx(-np.log(900), abs=0.05)
    assert mean(held) > unigram + 1 and mean(held) > mean([shuffled(t) for t in held]) + 1


def known_words(counts, rare):
    hashes = np.sort(np.random.default_rng(5).integers(0, 1 << 63, len(counts)).astype(np.uint64) * np.uint64(2))
    return word_network.Words(hashes, np.arange(len(counts)), np.array(counts, float), int(sum(counts)) + rare)


def test_work_of_a_word():
    counts = [100_000 // k for k in range(1, 10_001)]
    known = known_words(counts, sum(counts))
    sizes = np.diff(known.starts)
    assert sizes.sum() == 10_000 and (np.diff(known.groups) >= 0).all() and known.groups[-1] == len(sizes) == known.classes - 1
    work = known.classes + (np.array(counts) / known.total * sizes[known.groups[:-1]]).sum()
    assert work < 0.75 * (101 + 100 / 2)  # classes of equal sizes: all of them, and the words of one for half of the targets
    assert known_words([7] * 900, 0).classes == 31 and known_words([], 5).groups.tolist() == [0]
    asked = np.append(known.hashes[::-1], known.hashes + np.uint64(1))
    assert known.ids(asked).tolist() == [*range(9999, -1, -1), *[10_000] * 10_000]


@pytest.mark.parametrize("scale", [1, 60])  # the second has scores whose exponentials overflow
def test_a_step_of_learning(scale):
    known = known_words([40, 9, 9, 5, 2, 1], 20)
    net, rng = word_network.Net.start(known), np.random.default_rng(6)
    net.rows[:] = rng.normal(0, 0.5, net.rows.shape)
    net.output[:] *= scale
    context, target = rng.integers(0, known.n + 2, (50, 4)).astype(np.int32), rng.integers(0, known.n + 1, 50)

    def plain(rows):
        own, h, total = word_network.Net(known, rows), known.n + 2, 0.0
        for c, t in zip(context, target):
            hidden = np.tanh(sum(own.input[x] @ m for x, m in zip(c, own.matrices)) + own.hidden_bias)
            for scores, k in ((own.class_output @ hidden + own.class_bias, known.groups[t]), *([] if t == known.n else [
                    ((own.output @ hidden + own.bias)[: known.n][known.groups[:-1] == known.groups[t]], t - known.starts[known.groups[t]])])):
                total += scores[k] - scores.max() - np.log(np.exp(scores - scores.max()).sum())
        return total

    rows = net.rows.astype(np.float64)
    assert net.logs(context, target).sum() == pytest.approx(plain(rows), rel=1e-4)
    squares, after = np.ones_like(net.rows), net.rows.copy()
    word_network.Net(known, after).learn(context, target, squares)
    steps = (net.rows - after) * np.sqrt(squares) / word_network.STEP
    n, c = known.n + 2, known.classes
    read = [(r, k) for r in range(len(rows)) for k in range(rows.shape[1]) if r < n or k < word_network.HIDDEN or (r < n + c and k == rows.shape[1] - 1)]
    for at in read[::7]:
        up, down = rows.copy(), rows.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert steps[at] == pytest.approx((plain(down) - plain(up)) / 2e-5, rel=1e-2, abs=2e-2 * scale), at


def test_scores_of_words(spark, monkeypatch):
    monkeypatch.setattr(word_network, "LEAST", 3)
    monkeypatch.setattr(word_network, "GROWTH", 0)
    rows = [(1, "a b a c a b d e"), (2, None), (3, ""), (None, "a d b e"), (1, "a b a c a b d e"), (4, "q q c")]
    own = spark.createDataFrame(rows, "_id long, _text string")
    counts = word_network.counted(own.select("_text"))
    known = word_network.modelled(counts)
    n = Counter(w for _, t in rows if t for w in t.split())
    assert known.n == 2 and known.total == sum(n.values())  # a and b; c, d and e are equally frequent
    net = word_network.train(own.select("_text"), known)
    got = sorted((str(r["doc_id"]), r["n_words"], round(r["log_likelihood"], 6)) for r in word_network.score(own, counts, net).collect())
    want = []
    for i, t in rows:
        hashes, first = common.words(pa.array([t], pa.string()))
        ids = known.ids(hashes)
        rest = sum(v for w, v in n.items() if w not in "ab")
        value = word_network.log_chances(net, ids, first).sum() + sum(np.log(n[w] / rest) for w in (t or "").split() if w not in "ab")
        want.append((str(i), len(ids), round(float(value), 6)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-4)
    hashes, first = common.words(pa.array([rows[0][1]]))
    ids = known.ids(hashes)
    around = word_network.contexts(ids, first, known.n + 1)
    assert around[0].tolist() == [known.n + 1, known.n + 1, ids[1], ids[2]]
    chances = sum(np.exp(net.logs(around[:1], np.array([k]))[0]) for k in range(known.n + 1))
    assert chances == pytest.approx(1, abs=1e-4)  # all words and the rare class


def test_licences(spark, docs, awkward, empty):
    model = licences.fit(docs)
    assert model.accuracy > 0.9
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
               "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "the cat sat under the tree": ""}
    frame = spark.createDataFrame([(i, "thon eratsh\n" + t + "\nwhou therou") for i, t in enumerate(notices)], "doc_id long, text string")
    assert [r["families"] for r in licences.scan(frame, model=model).orderBy("doc_id").collect()] == list(notices.values())
    wide = spark.createDataFrame([(1, " ".join(["thon"] * 300) + " released under the mit license " + " ".join(["whou"] * 300))], "doc_id long, text string")
    assert licences.scan(wide, model=model).first()["families"] == "MIT"
    assert licences.scan(awkward, model=model).count() == 12 and licences.scan(empty).count() == 0


def test_wrapped_licences(spark, docs):
    model = licences.fit(docs)
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU %sGeneral Public License as published by\n# the Free Software Foundation, either version %s of the License, or\n# (at your option) any later version."
    notices = {"GPL-3.0": gnu % ("", "3"), "GPL-2.0": gnu % ("", "2"), "LGPL": gnu % ("Lesser ", "3"), "AGPL-3.0": gnu % ("Affero ", "3"),
               "Apache-2.0": " * Licensed under the Apache\n * License, Version 2.0 (the \"License\");", "MIT": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation",
               "BSD": "Redistribution and use in source and binary forms,\r\nwith or without modification, are permitted provided", "MPL-2.0": "// This Source Code Form is subject to the terms\n// of the Mozilla Public License, v. 2.0.",
               "CC-BY-4.0": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-SA-4.0": "Licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
               "CC-BY-NC-4.0": "Licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "CC0-1.0": "Dedicated to the\npublic domain\nunder CC0 1.0.", "Proprietary": "All rights reserved. No part\nof this work may be reproduced."}
    assert set(notices) == set(licences.FAMILIES)
    pad = "\n".join(["thon eratsh whou"] * 30)
    rows = [(k, t) for k, t in notices.items()] + [(f"{k} in a long paragraph", f"{pad}\n{t}\n{pad}") for k, t in notices.items()]
    rows.insert(0, ("LGPL at a break", "modify it under the terms of the GNU Lesser\nGeneral Public License as published by the Free Software Foundation, either version 3\nof the License"))
    rows.append(("two", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."))
    rows.append(("apart", "Licensed under the Apache\n\nLicense, Version 2.0"))
    got = {r["doc_id"]: (r["families"], r["n_unknown"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), model=model).collect()}
    want = {k: (k.split(" ")[0], 0) for k, _ in rows[:-2]}
    assert {k: got[k] for k in want} == want
    assert got["two"] == ("Apache-2.0,MIT", 0) and got["apart"][0] == ""


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: [int(c) for c in m[0] if c.isdigit()]
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in _EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_personal_data(spark, docs, awkward, empty):
    tricky = ["a@b.c@d.e", "@x.y", " @foo.bar@x.y", "a@b", "1.2.3", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "+1 (2", "+1234567890", "a..b@c-d.e-", "1.1.1.1@x.y",
              "é +49 30 1234567 é", "4111-1111-1111-1112", "+1+12345678901", "a@b.c.d@e.f"]
    texts = tricky + [r["text"] for r in docs.select("text").collect()]
    for text in texts:
        assert pii_crf.base_spans(text) == plain_spans(text), text
    rows = {r["doc_id"]: r for r in pii_crf.find(docs).collect()}
    for r in docs.collect():
        base = [s for s in rows[r["doc_id"]]["found"] if s["base"]]
        assert [(pii_crf.KINDS.index(s["kind"]), s["start"], s["end"]) for s in base] == plain_spans(r["text"])
    got = {r["doc_id"]: r for r in pii_crf.find(awkward).collect()}
    assert got[7]["n_phone"] == 1 and got[7]["n_email"] == 1 and got[2]["spans"] == ""
    assert pii_crf.find(empty).count() == 0
    assert pii_crf.masked("x me@a.b y", [("email", 2, 8)]) == "x <EMAIL> y"


def test_skip_chain_carries_labels():
    weights = np.zeros((pii_crf.FEATURES + 2 * pii_crf.LABELS, pii_crf.LABELS))
    weights[pii_crf._SHAPES + 3, 4] = 8  # covered by a phone pattern
    weights[0, 0] = 1
    weights[pii_crf.FEATURES + pii_crf.LABELS :] = 6 * np.eye(pii_crf.LABELS)
    text = "call +1 (375) 555-4393 now, " + "word " * 300 + "and 555-4393 again; not 777-1111"
    graph = pii_crf.Graph()
    graph.add(0, text, pii_crf.base_spans(text))
    best = pii_crf.marginals(graph, weights).argmax(axis=1)
    assert [text[a:b] for (_, a, b), k in zip(graph.spans, best) if k == 4] == ["+1", "375", "555-4393", "555-4393"]


def test_evidence_reaches_every_repeat():
    weights = np.zeros((pii_crf.FEATURES + 2 * pii_crf.LABELS, pii_crf.LABELS))
    weights[pii_crf._SHAPES + 3, 4] = 8
    weights[0, 0] = 1
    for agree in (pii_crf.AGREE, 6.0):
        weights[pii_crf.FEATURES + pii_crf.LABELS :] = agree * np.eye(pii_crf.LABELS)
        for repeats in (3, 40, 400):
            text = "call +1 (375) 555-4393 now, " + ("word " * 30 + "and 555-4393 again; not 777-1111 ") * repeats
            graph = pii_crf.Graph()
            graph.add(0, text, pii_crf.base_spans(text))
            chance = pii_crf.marginals(graph, weights)
            assert [text[a:b] for (_, a, b), k in zip(graph.spans, chance.argmax(axis=1)) if k == 4] == ["+1", "375", *["555-4393"] * (repeats + 1)]
            assert np.ptp([c[4] for (_, a, b), c in zip(graph.spans[3:], chance[3:]) if text[a:b] == "555-4393"]) < 1e-2


def test_training_sample_is_bounded(spark):
    rows = [(1, "call 555-4393")] * 300 + [(i, "mail a@b.org") for i in range(300)] + [(i, "9 " * 40_000) for i in range(1000, 1010)] + [(i, "none") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (20, 200, 5000):
        texts = [r["_text"] for r in pii_crf.sampled(frame, sample=sample).collect()]
        assert len(texts) <= sample and (len(texts) == 610 or sample < 610) and "none" not in texts and max(map(len, texts)) <= pii_crf.TRAIN_CHARS
    copies = spark.createDataFrame([(i, "mail a@b.org") for i in range(2000)], "doc_id long, text string")
    assert pii_crf.sampled(copies, sample=100).count() == 100  # of one text's copies a share is picked, not all or none


def test_messages_settle_on_a_long_chain():
    rng = np.random.default_rng(5)
    weights = np.zeros((pii_crf.FEATURES + 2 * pii_crf.LABELS, pii_crf.LABELS))
    weights[: pii_crf.FEATURES] = rng.normal(0, 0.1, (pii_crf.FEATURES, pii_crf.LABELS))
    weights[pii_crf._SHAPES, 1] = 8
    chain = weights[pii_crf.FEATURES : pii_crf.FEATURES + pii_crf.LABELS]
    chain[:] = 7 * np.eye(pii_crf.LABELS)
    n, graph = 60, pii_crf.Graph()
    graph.features = np.zeros((n, pii_crf.FEATURES), int).tolist()
    graph.features[0][pii_crf._SHAPES] = 1
    graph.labels, graph.chain, graph.longest = [0] * n, [(i, i + 1) for i in range(n - 1)], n
    alone, forth, back = np.exp(np.array(graph.features) @ weights[: pii_crf.FEATURES]), [np.ones(pii_crf.LABELS)], [np.ones(pii_crf.LABELS)]
    for i in range(n - 1):
        forth.append((forth[-1] * alone[i]) @ np.exp(chain))
        back.append((back[-1] * alone[n - 1 - i]) @ np.exp(chain))
        forth[-1], back[-1] = forth[-1] / forth[-1].sum(), back[-1] / back[-1].sum()
    want = alone * np.array(forth) * np.array(back[::-1])
    assert np.allclose(pii_crf.marginals(graph, weights), want / want.sum(axis=1, keepdims=True), atol=5e-3)


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 1, (pii_crf.FEATURES + 2 * pii_crf.LABELS, pii_crf.LABELS))
    for at in (pii_crf.FEATURES, pii_crf.FEATURES + pii_crf.LABELS):
        weights[at : at + pii_crf.LABELS] += weights[at : at + pii_crf.LABELS].T.copy()
    graph = pii_crf.Graph()
    graph.features = rng.integers(0, 2, (3, pii_crf.FEATURES)).tolist()
    graph.labels, graph.chain, graph.skip = [0, 0, 0], [(0, 1)], [(1, 2)]
    alone = np.array(graph.features) @ weights[: pii_crf.FEATURES]
    t, s = weights[pii_crf.FEATURES : pii_crf.FEATURES + pii_crf.LABELS], weights[pii_crf.FEATURES + pii_crf.LABELS :]
    joint = np.exp(alone[0][:, None, None] + alone[1][None, :, None] + alone[2][None, None, :] + t[:, :, None] + s[None, :, :])
    joint /= joint.sum()
    want = np.array([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(pii_crf.marginals(graph, weights), want, atol=2e-2)


def test_decontaminate_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "C d E"), (2, None), (3, ""), (None, "a b c d e f g"), (4, "d e"), (5, "one"), (1, "C d E")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.scan(awkward, bench).collect()}
    assert decontaminate.scan(awkward, bench).count() == 12
    assert (rows[5]["n_words"], rows[5]["n_hit"], rows[5]["items"]) == (7, 3, ["1", "4"])
    assert rows[8]["n_hit"] == 1 and rows[1]["n_hit"] == 0 and rows[2]["n_words"] == 0
    scanned = decontaminate.scan(awkward, bench)
    assert decontaminate.remove_documents(awkward, scanned).count() == 7
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(awkward, scanned).collect()}
    assert cut[5] == "a b f g" and cut[6] == "A b f g" and cut[2] is None
    one = decontaminate.scan(awkward, bench, block_rows=1)
    key = lambda f: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in f.collect())
    assert key(one) == key(scanned)
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(awkward, bench.where("false")).where("n_hit > 0").count() == 0


def test_pipeline(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    top = plain_components(texts.items(), 80)
    texts = {i: t for i, t in texts.items() if top[i] == i}
    clean = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: clean.findall("".join(c.lower() if c.isascii() else c for c in t))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(w) for w in windows}
    for i, t in list(texts.items()):
        w = words(t)
        if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            del texts[i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= set(texts) and max(Counter(r["doc_id"] for r in got).values()) <= 2
    mixed = Counter(r["doc_id"] for r in mixing.repeat_documents(docs.where(F.col("doc_id").isin(list(texts)))).collect())
    assert Counter(r["doc_id"] for r in got) == mixed
    plain = Tokenizer.from_file(TOKENS)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
