"""Steps that larger tables stopped: what they build, not how long they take."""

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_evidence_of_parts_is_not_sent_through_the_driver(spark):
    plan = physical(entry.queries()["evidence_sets"](spark, SOURCE))
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan


def test_encoded_store_makes_its_rows_once(spark):
    plan = physical(entry.queries()["encoded_store"](spark, SOURCE))
    assert "Window" not in plan and plan.count("encoded") >= 2


def test_trees_are_walked_once(spark):
    for name in ("tree_productions", "remove_invalid", "tree_roundtrip"):
        plan = physical(entry.queries()[name](spark, SOURCE))
        assert plan.count("MapInArrow") == (2 if name == "tree_roundtrip" else 0), (name, plan)  # a round trip writes texts and reads them


def test_walks_give_only_the_columns_asked_for(spark):
    from codeloom.plans import projection

    only = ("pid", "seq_in", "iattrib", "calls")
    for most in (None, 3):  # programs in one part, and most of them in several
        whole = projection.iterator_program_nodes(spark, SOURCE, most)
        narrow = projection.iterator_program_nodes(spark, SOURCE, most, only)
        assert tuple(narrow.columns) == only
        assert whole.select(*only).exceptAll(narrow).isEmpty() and narrow.exceptAll(whole.select(*only)).isEmpty()


def test_parts_are_dealt_before_their_text_is_made(spark):
    assert "Exchange hashpartitioning(p_partkey" in entry.queries()["call_display"](spark, SOURCE)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_outside_brackets_without_a_step_per_character(spark):
    from pyspark.sql import functions as F

    from codeloom.functions.javatypes import split_top_level

    text = ",".join(["java.util.Map<a,b<c,d>>"] * 3000)  # 69,000 characters; sums per character were quadratic in them
    got = spark.createDataFrame([(text,), ("a<b,c",), ("a>,b",), (",x,",)], "t string").select(F.size(split_top_level(F.col("t"))).alias("n"), split_top_level(F.col("t"))[0].alias("first")).collect()
    assert [tuple(r) for r in got] == [(3000, "java.util.Map<a,b<c,d>>"), (1, "a<b,c"), (1, "a>,b"), (1, "x")]
