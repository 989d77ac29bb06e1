"""Programs that are dealt once: steps that look at programs one by one shuffle nothing more."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import encoding as en, evidence, rendering, scope as sc, sequences, siblings, trees as tr
from codeloom.plans import projection as pj
from codeloom.queries import checks as qc, corpus, lowered as ql
from codeloom.session import persist_buckets
from tests.test_lowered import statement

SOURCE = "/root/testdata/sf0.001"


def exchanges(df):
    """Shuffles of the plan, without broadcasts, which hang on sizes."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_uses_and_code_are_found_without_a_shuffle(spark):
    nodes, n = qc.dealt_nodes(spark, SOURCE)
    assert n >= 8 and exchanges(sc.resolve_uses(nodes, qc.GIVEN)) == 0
    rows = pj.stored_program_nodes(spark, SOURCE, ql.RENDERED)[0]
    assert exchanges(rendering.render(rows)) == 0


def test_flags_and_nesting_meet_where_their_programs_are(spark):
    nodes, n = qc.dealt_nodes(spark, SOURCE, "seq_in", "seq_out", "list_end")
    used = persist_buckets(sc.resolve_uses(nodes, qc.GIVEN), "uses", "pid", n)
    assert exchanges(sc.undeclared(used).select("pid").distinct()) == 0
    assert exchanges(tr.nesting(nodes)) == 0


def test_nesting_of_short_programs_is_that_of_bins(spark, monkeypatch):
    nodes = pj.stored_program_nodes(spark, SOURCE, ("pid", "node_id", "tag", "seq_in", "seq_out", "list_end"))[0]
    short = sorted_rows(tr.nesting(nodes))
    monkeypatch.setattr(tr, "SHORT", 8)
    mixed = sorted_rows(tr.nesting(nodes.withColumn("pid", F.col("pid"))))
    assert short == mixed and len(short) == nodes.select("pid").distinct().count()


@pytest.mark.parametrize("node", (pj.line_nodes, pj.raw_line_nodes))
def test_lines_give_the_nodes_of_their_texts(spark, tmp_path, node):
    """Dealt lines against texts of whole programs: lines of one place, repeated lines, a null program, lines that say nothing."""
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet").where("l_orderkey < 400")
    same = lines.withColumn("l_linenumber", F.lit(1)).withColumn("l_partkey", F.lit(7).cast("bigint")).withColumn("l_suppkey", F.lit(3).cast("bigint")).withColumn("l_extendedprice", F.lit(1.0).cast(lines.schema["l_extendedprice"].dataType))
    odd = lines.where("l_orderkey < 100")
    every = lines.unionByName(same).unionByName(odd.withColumn("l_orderkey", F.lit(None).cast("bigint"))).unionByName(odd).unionByName(odd.withColumn("l_returnflag", F.lit("X")))
    every.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{SOURCE}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    joined = pj.in_parts(spark.read.parquet(str(tmp_path / "lineitem.parquet")).withColumnRenamed("l_orderkey", "pid")).join(
        pj.apis(spark, str(tmp_path)).select("p_partkey", "api", "returns"), F.col("l_partkey") == F.col("p_partkey"))
    whole = tr.flatten_parts(pj._part_texts(joined, node()))
    dealt = pj._node_rows(spark, str(tmp_path), None, None, node)[0]
    assert sorted_rows(dealt) == sorted_rows(whole)


def test_bucketed_rows_come_back_whole(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("pid"), "id").unionByName(spark.range(3).select(F.lit(None).cast("bigint").alias("pid"), "id"))
    back = persist_buckets(rows, "rows", "pid", 21)  # neither dealt nor few: each task has most buckets
    assert sorted_rows(back) == sorted_rows(rows) and exchanges(back.groupBy("pid").count()) == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("codeloom")]


def random_nodes(spark):
    r = random.Random(3)
    bodies = [[statement(r, 0) for _ in range(r.randrange(1, 6))] for _ in range(120)]
    rows = tr.flatten(spark.createDataFrame([(i, json.dumps({"node": "DSubTree", "_nodes": body})) for i, body in enumerate(bodies)], "pid bigint, ast string"))
    return rows.withColumn("tag", F.when(F.col("tag") == "DAPICall", "DAPIInvoke").otherwise(F.col("tag"))).cache()


@pytest.mark.parametrize("steps", (tr.topdown_paths, tr.subtree_hashes, lambda nodes: tr.subtree_hashes(nodes, F.get("calls", F.lit(0))["call"])))
def test_programs_one_by_one_as_by_joins(spark, monkeypatch, steps):
    nodes = random_nodes(spark)
    found = []
    for short in (1 << 20, 12, 0):
        monkeypatch.setattr(sc, "SHORT", short)
        found.append(sorted_rows(steps(nodes)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 300


def test_paths_hashes_texts_and_codes_need_no_shuffle(spark):
    nodes = pj.stored_program_nodes(spark, SOURCE)[0]
    assert exchanges(tr.topdown_paths(nodes)) == exchanges(tr.subtree_hashes(nodes)) == exchanges(tr.unflatten(nodes)) == 0
    assert exchanges(en.columns(en.linearise(nodes).withColumn("value", F.lit(1)).withColumn("type_id", F.lit(1)))) == 0


def test_flatten_gives_some_columns(spark):
    texts = spark.createDataFrame([(1, '{"_nodes":[{"node":"DLoop","_cond":[],"_body":[{"node":"DReturnVar","_id":"a"}]}]}'), (2, '{"_nodes":[{"node":5}]}'), (3, "x")], "pid bigint, ast string")
    only = ("scope", "pid", "tag", "slot_ends", "calls")
    assert sorted_rows(tr.flatten(texts, only=only)) == sorted_rows(tr.flatten(texts).select(*only))


def test_evidence_of_dealt_programs_is_that_of_blocks(spark, monkeypatch):
    dealt = sorted_rows(corpus.encode_evidence(spark, SOURCE))
    places, n = corpus.evidence_places(spark, SOURCE)
    assert n and exchanges(evidence.encoded_sets(persist_buckets(places, "places", "pid", n), spark.createDataFrame([], "kind string, token string, id bigint"), dealt=True)) <= 3  # the vocabulary's join
    assert str(places._jdf.queryExecution().executedPlan()).count("hashpartitioning(pid") == 1
    monkeypatch.setattr(pj, "PART_LINES", 3)
    assert corpus.evidence_places(spark, SOURCE)[1] == 0
    assert sorted_rows(corpus.encode_evidence(spark, SOURCE)) == dealt


def test_ways_one_by_one_are_those_of_joins(spark, monkeypatch):
    nodes = random_nodes(spark)
    found = []
    for short in (1 << 20, 10, 0):
        monkeypatch.setattr(sc, "SHORT", short)
        found.append(sorted_rows(sequences.call_sequences(nodes, 4, 9)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100 and any("too" in r for r in found[0])


def test_ways_of_dealt_programs_need_no_shuffle(spark):
    nodes, n = pj.dealt_program_nodes(spark, SOURCE, ("pid", "node_id", "parent_id", "slot", "slot_pos", "depth", "scope", "tag", "calls"))
    assert exchanges(sequences.call_sequences(nodes, buckets=n)) == 0


def test_siblings_of_short_files_are_those_of_places(spark, monkeypatch):
    """Files in one list, files by places, both, and repeated ids."""
    methods = spark.range(400).select(F.col("id").alias("pid"), F.when(F.col("id") < 60, 0).when(F.col("id") < 399, F.col("id") % 90).alias("file"), F.concat(F.lit("m@"), (F.col("id") % 300).cast("string")).alias("method"))
    want = sorted_rows(siblings._by_places(methods, 12, 10))
    calls = methods.select("pid", F.explode(F.array(*[F.concat(F.lit("m@"), ((F.col("pid") + 90 * i) % 300).cast("string")) for i in range(1, 5)])).alias("callee"))
    for most in (256, 20, 0):
        monkeypatch.setattr(siblings, "SHORT_FILE", most)
        assert sorted_rows(siblings.sample_siblings(methods)) == want
        rows = siblings.resolve_internal(calls, siblings.sample_siblings(methods)).select("pid", "callee", "sibling_pid", "local_method")
        lists = siblings.resolve_internal(calls, siblings.sample_siblings(methods, listed=True)).select("pid", "callee", "sibling_pid", "local_method")
        assert sorted_rows(rows) == sorted_rows(lists) and rows.count() > 50
    twice = methods.unionByName(methods.where("pid in (3, 70)").withColumn("method", F.lit("other")))
    assert twice.count() == 402 and siblings.sample_siblings(twice).where("pid = 70").count() == siblings._by_places(twice, 12, 10).where("pid = 70").count()
