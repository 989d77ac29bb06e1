"""Encoded programs: vocabularies without numbered rows, rows without a type spread over tasks, walks that give few columns."""

import json

from pyspark.sql import functions as F

from codeloom.operators import encoding as en, trees as tr, vocab
from codeloom.plans import projection as pj

PARTS = [
    '[{"node":"DInfix","_op":["+"],"_left":{"node":"DVarDecl","_id":"a","_returns":"int"},"_right":[7,{"node":"DReturnVar","_var":"b"}]}]',
    '[{"node":"DLoop","_cond":[{"node":"DAPIInvoke","_calls":[{"_call":"p.q(int,x)","fp":["v",null,{"node":"z"}],"_returns":"int"},{"_call":"p.r()"}],'
    '"expr_var_id":{"node":"DVarDecl"},"ret_var_id":"w","_returns":"int"}],"_body":[]},{"node":"DClsInit","_call":"s()","fp_var_ids":[{"node":"DVarDecl","_id":"c"}],"_id":"d"},'
    '{"node":"DInternalAPICall","int_meth_id":"m","_op":"-"}]',
    "[]",
]


def test_a_walk_of_few_columns_gives_the_same_rows(spark):
    parts = spark.createDataFrame([(k, 0, text) for k, text in enumerate(PARTS)], "pid long, part long, ast string")
    whole = tr.flatten_parts(parts).select(*tr.PLAIN).collect()
    assert len(whole) == 8 and sorted(map(str, tr.flatten_parts(parts, tr.PLAIN).collect())) == sorted(map(str, whole))
    few = tr.flatten_parts(parts, ["tag", "pid"])
    assert few.columns == ["tag", "pid"] and sorted(few.collect()) == sorted((r["tag"], r["pid"]) for r in whole)
    rows: list = []
    tr._visit_plain(json.loads(PARTS[0]), 1, rows)
    assert [len(r) for r in rows] == [len(tr.PLAIN)] * 3


def test_vocabulary_of_rows(spark):
    rows = [(5, 0, "b"), (5, 9, "a"), (5, 3, "a"), (2, 7, "c"), (2, 8, "b"), (2, 1 << 55, "d"), (2, 7, "c"), (-3, 4, "e"), ((1 << 63) - 1, 1, "f"), (None, 0, "a")]
    tokens = spark.createDataFrame(rows, "doc bigint, pos bigint, token string").repartition(3)
    assert {r.token: r.id for r in vocab.build_vocab_of_rows(tokens, "doc", "pos").collect()} == {"e": 1, "c": 2, "b": 3, "d": 4, "a": 5, "f": 6}


def test_vocabularies_need_no_numbered_rows(spark):
    nodes = tr.flatten_parts(spark.createDataFrame([(k, 0, text) for k, text in enumerate(PARTS)], "pid long, part long, ast string"))
    rows = en.linearise(nodes)
    unnumbered = rows.drop("pos")
    assert "Window" not in unnumbered._jdf.queryExecution().optimizedPlan().toString()
    vocabulary = en.vocabularies(unnumbered)
    got = {(r.kind, r.token): r.id for r in vocabulary.collect()}
    want: dict = {}
    seen = [(r.pid, 2 * r.pos, r.vocabulary, r.token) for r in rows.collect()] + [(r.pid, 2 * r.pos + 1, "type", r.used_as) for r in rows.collect() if r.used_as is not None]
    for _, _, kind, token in sorted((s for s in seen if s[2] != "symtab"), key=lambda s: s[:2]):
        want.setdefault((kind, token), sum(k == kind for k, _ in want) + 1)
    assert got == want
    coded = {(r.pid, r.pos): (r.value, r.type_id) for r in en.encode_rows(rows, vocabulary).collect()}
    known = lambda kind, token: 0 if token is None else want.get((kind, token), 0)
    assert coded == {(r.pid, r.pos): (known(r.vocabulary, r.token), known("type", r.used_as)) for r in rows.collect()}


def test_rows_without_a_type_do_not_meet(spark):
    rows = spark.range(4000).select(F.col("id").alias("pid"), F.lit("api").alias("vocabulary"), F.lit("t").alias("token"), F.lit(None).cast("string").alias("used_as"))
    known = spark.createDataFrame([("api", "t", 1), ("type", "int", 1)], "kind string, token string, id long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        parts = [r["count"] for r in en.encode_rows(rows, known).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(parts) == 4000 and max(parts) < 2000


def test_lines_meet_no_list_of_large_programs_if_there_are_none(spark):
    lines = spark.range(100).select((F.col("id") % 9).alias("pid"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"))
    assert "Join" not in pj.in_parts(lines)._jdf.queryExecution().optimizedPlan().toString()
    large = pj.in_parts(lines, 11)
    assert large.where("pid = 0").count() == 12 and large.where("pid = 0 and part <> 0").count() == 12 and large.where("pid > 0 and part <> 0").count() == 0
