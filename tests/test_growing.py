"""Stores that grow: ids stay, unfinished versions do not count, nulls and repeats."""

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from codeloom.session import new_folder
from codeloom.sources.growing import GrowingStore


def bucket():
    return F.floor(F.col("at") / 2)


def rows(spark, *values):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(values)], "kind string, token string, at long")


def by_rule(deliveries):
    """Append only: a token's id is its place among those of its kind."""
    ids = {}
    for number, values in enumerate(deliveries, 1):
        for kind, token in values:
            if (kind, token) not in ids:
                ids[kind, token] = (1 + sum(k == kind for k, _ in ids), number)
    return ids


def test_ids_never_change(spark):
    deliveries = [
        [("a", "x"), ("b", "x"), ("a", "y"), ("a", "x"), (None, "x"), ("a", None)],
        [],
        [("a", "z"), ("c", "x"), ("a", "y"), (None, "x"), (None, "w"), ("a", None), ("b", "q"), ("a", "k")],
    ]
    store = GrowingStore(spark, new_folder(spark, "grow"), "kind string, token string", numbered=True, group="kind").create()
    assert store.latest() == 0 and store.read().count() == 0
    for i, values in enumerate(deliveries, 1):
        assert store.merge(rows(spark, *values), ["at"], bucket()) == i
        got = {(r.kind, r.token): (r.id, r.version) for r in store.read().collect()}
        assert got == by_rule(deliveries[:i])
    assert {(r.kind, r.token): (r.id, r.version) for r in store.read(1).collect()} == by_rule(deliveries[:1])
    with pytest.raises(ValueError):
        store.read(4)
    with pytest.raises(AnalysisException):
        store.create()
    assert store.latest() == 3 and store.read().count() == len(by_rule(deliveries))


def test_modes(spark):
    store = GrowingStore(spark, new_folder(spark, "grow"), "token string", numbered=True).create()
    corpus = rows(spark, ("k", "x"), ("k", "y"), ("k", "x")).withColumn("_first", F.lit(7))
    trained = store.encode(corpus, infer=False, order=["at"], bucket=bucket())
    assert sorted((r.at, r.id, r._first) for r in trained.collect()) == [(0, 1, 7), (1, 2, 7), (2, 1, 7)]
    asked = rows(spark, ("k", "y"), ("k", "new"), ("k", None))
    assert sorted((r.at, r.id) for r in store.encode(asked).collect()) == [(0, 2), (1, 0), (2, 0)]
    assert store.latest() == 1
    store.encode(asked, infer=False, order=["at"], bucket=bucket())
    assert sorted((r.at, r.id) for r in store.encode(asked).collect()) == [(0, 2), (1, 3), (2, 4)]
    assert sorted((r.at, r.id) for r in store.encode(asked, version=1).collect()) == [(0, 2), (1, 0), (2, 0)]


def test_broken_merge_is_not_seen(spark):
    path = new_folder(spark, "grow")
    store = GrowingStore(spark, path, "role string, declared string").create()
    pairs = lambda *p: spark.createDataFrame(list(p), "role string, declared string")
    store.merge(pairs(("arg", "int"), ("arg", None), ("arg", "int")))
    pairs(("ret", "lost")).write.parquet(f"{path}/rows/version=2")  # a writer that was lost before it was done
    again = GrowingStore(spark, path, "role string, declared string")
    assert {(r.role, r.declared) for r in again.read().collect()} == {("arg", "int"), ("arg", None)}
    assert again.merge(pairs(("arg", None), ("ret", "long"))) == 2
    assert {(r.role, r.declared, r.version) for r in again.read().collect()} == {("arg", "int", 1), ("arg", None, 1), ("ret", "long", 2)}
