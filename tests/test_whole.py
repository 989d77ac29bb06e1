"""Nothing is lost on the way: null keys, blank lines, long programs, further clusters."""

from pyspark.sql import functions as F

from codeloom.operators import clusters, encoding as en, ranking
from codeloom.sources import programs as src


def test_positions_keep_rows_with_null_keys_and_order(spark):
    rows = spark.createDataFrame([("a", 5), ("a", None), (None, 1), (None, 7), (None, None), ("b", 3)], "k string, v int")
    bucket = F.floor(F.col("v") / 4)
    got = ranking.positions(rows, [F.col("v")], bucket, keys=["k"], total="n").collect()
    assert sorted(((r.k or "~"), -1 if r.v is None else r.v, r.pos, r.n) for r in got) == [
        ("a", -1, 0, 2), ("a", 5, 1, 2), ("b", 3, 0, 1), ("~", -1, 0, 3), ("~", 1, 1, 3), ("~", 7, 2, 3),
    ]
    assert sorted(r.pos for r in ranking.positions(rows, [F.col("v"), F.col("k")], bucket).collect()) == list(range(6))


def test_running_sum_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 2), (None, 9, 5), ("a", 1, 4), ("a", None, 1)], "k string, t int, v int")
    got = ranking.running_sum(rows, F.col("v"), [F.col("t")], F.floor(F.col("t") / 4), keys=["k"]).collect()
    assert sorted(((r.k or "~"), r.v, r.running) for r in got) == [("a", 1, 1), ("a", 4, 5), ("~", 2, 2), ("~", 5, 7)]


def test_long_programs_keep_their_row(spark):
    rows = spark.range(7).select(F.when(F.col("id") < 5, 1).otherwise(2).alias("pid"), F.pmod("id", F.lit(5)).alias("pos"), (F.col("id") + 10).alias("value"), F.lit(1).alias("node_type"), F.lit(0).alias("type_id"))
    got = {r.pid: (r.length, r.cut, r.value) for r in en.columns(rows, width=3).collect()}
    assert got == {1: (5, True, [10, 11, 12]), 2: (2, False, [15, 16, 0])}


def test_clusters_come_from_the_data(spark):
    members = spark.createDataFrame([(0, 1, ["a"]), (12, 2, ["a"]), (12, 3, ["b"])], "cluster int, id int, items array<string>")
    averages = clusters.mean_jaccard(members)
    assert sorted((r.i, r.j) for r in clusters.matrix(averages).collect()) == [(0, 0), (0, 12), (12, 0), (12, 12)]
    assert {r.i: r.line for r in clusters.matrix_lines(averages).collect()} == {0: "[0.000, 0.500]", 12: "[0.500, 0.000]"}


def test_blank_lines_are_bad_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": 1}\n\n  \n{"a": 2\n')
    good, bad = src.scan_lines(spark, str(tmp_path), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 3
