"""The filter audit against all orders, one by one."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from codeloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask string, n string, good string, _id string, _text string, s string, size string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Rows of the audit from (doc_id, text, source) and {doc_id: (good, toxic)}."""
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = WORDS.findall(text)
        repeat = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), repeat]
        docs.append((source or "", {x for x, bad in zip("ABCDE", fails) if bad}, *labels.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                fail = sum(x in d[1] for d in own)
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fail - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = frame.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "p", "m", "n", "g", "i", "t", "s", "z") for i, t, s in rows], SCHEMA)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (1, long, "a"), (3, None, None), (4, "", ""), (5, " \n\t", "a"), (None, long, "a"), (None, None, "b"), (6, "A B C " * 30, "a"),
            (7, "x " * 60, "b"), (8, "# " + long, None), (9, long + " ÄÖ", "a"), (10, "é" * 50, "b")]
    labels = spark.createDataFrame([(1, 1, None, "x"), (1, 0, 1, "x"), (2, None, None, "x"), (6, 0, 1, "x"), (7, 1, 0, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, _good string")
    want = plain(rows, {1: (True, True), 6: (False, True), 7: (True, False)})
    assert got(filter_audit.audit(table_of(spark, rows), labels)) == want


def test_a_text_that_fills_the_table(spark):
    rows = [(i, "same text " * 40, "hot" if i % 3 else "cold") for i in range(900)] + [(1000 + i, f"other {i}", "hot") for i in range(50)]
    found = got(filter_audit.audit(table_of(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found["hot", "EABCD", 1] == (50, 600, 0, 0, 0, 0, plain_total(found, "hot", "E"))
    assert found["cold", "EABCD", 1][:3] == (1, 299, 0)


def plain_total(found, part, letter):
    return sum(row[1] for (p, order, step), row in found.items() if p == part and order[step - 1] == letter)


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table_of(spark, []), labels).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_potentials_give_shapley_values(spark, n):
    games = [[0] + [(s * 7919 + k * 104729) % 50 for s in range(1, 2**n)] for k in range(6)]
    frame = spark.createDataFrame([(k, g) for k, g in enumerate(games)], "k int, v array<long>")
    for row in frame.select("k", filter_audit.shapley(filter_audit.potentials(F.col("v"), n), n).alias("x")).collect():
        want = [0] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += games[row["k"]][s | 1 << i] - games[row["k"]][s]
                s |= 1 << i
        assert row["x"] == want
