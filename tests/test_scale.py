"""Results hold when one key has most of the rows; positions, batches, stores, streams."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import beam, checks, clusters, dedup, ranking, siblings, vocab
from codeloom.session import new_folder
from codeloom.sources import programs as src, stores
from codeloom.streaming import ingest


def test_positions_with_a_hot_group(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 3500, 0).otherwise(F.col("id") % 7).alias("g"))
    out = ranking.positions(df, [F.col("id")], F.floor(F.col("id") / 100), keys=["g"], total="n").collect()
    groups = {}
    for r in sorted(out, key=lambda r: r.id):
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        assert [r.pos for r in rows] == list(range(len(rows)))
        assert {r.n for r in rows} == {len(rows)}


def test_running_sum(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    out = ranking.running_sum(df, F.col("id"), [F.col("id")], F.floor(F.col("id") / 64), keys=["g"]).collect()
    for r in out:
        assert r.running == sum(i for i in range(r.g, r.id + 1, 2))


@pytest.mark.parametrize("rows,chunks", [(100, 32), (31, 32), (64, 32), (1, 3)])
def test_equal_chunks_differ_by_one(spark, rows, chunks):
    out = ranking.equal_chunks(spark.range(rows), chunks, "id", F.floor(F.col("id") / 8)).groupBy("chunk").count().collect()
    sizes = [r["count"] for r in sorted(out, key=lambda r: r.chunk)]
    assert sum(sizes) == rows and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_batches_too_few_rows(spark):
    assert ranking.whole_batches(spark.range(50), 64, 12, "id").count() == 0
    whole = ranking.whole_batches(spark.range(200), 64, 12, "id")
    assert {r["count"] for r in whole.groupBy("batch_id").count().collect()} == {64} and whole.count() == 192
    again = ranking.whole_batches(spark.range(200).repartition(5), 64, 12, "id")
    assert whole.exceptAll(again).count() == 0


def test_siblings_of_a_hot_file(spark):
    methods = spark.range(3000).select(
        F.col("id").alias("pid"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("file"), F.concat(F.lit("m@"), F.col("id").cast("string")).alias("method")
    )
    out = siblings.sample_siblings(methods).collect()
    per = {}
    for r in out:
        per.setdefault(r.pid, []).append(r)
    assert set(per) == set(range(2000))  # a file with one method has no siblings
    for pid, rows in per.items():
        ids = sorted(r.id for r in rows)
        assert ids == list(range(len(rows))) and len(rows) in (9, 10)
        assert len({r.sibling_pid for r in rows}) == len(rows) and pid not in {r.sibling_pid for r in rows}


def test_dedup_of_a_hot_key(spark):
    df = spark.range(10000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")))
    kept = dedup.first_per_key(df, [F.col("k")], "id")
    assert kept.count() == df.select("k").distinct().count()
    assert kept.where("k = 'hot'").first().id == 0


def test_vocab_round_trip(spark):
    tokens = spark.createDataFrame([(5, 0, "b"), (5, 1, "a"), (2, 0, "c"), (2, 1, "b")], "doc bigint, pos int, token string")
    built = vocab.build_vocab(tokens, "doc", "pos")
    assert {r.token: r.id for r in built.collect()} == {"c": 1, "b": 2, "a": 3}
    coded = vocab.encode(spark.createDataFrame([("a",), ("zz",)], "token string"), built)
    assert {r.token: r.id for r in coded.collect()} == {"a": 3, "zz": 0}
    assert [r.token for r in vocab.decode(coded.select("id"), built).collect()] == ["a"]


def test_mean_jaccard_against_brute_force(spark):
    rows = [(i % 3, i, sorted({(i * j) % 7 for j in range(i % 4)})) for i in range(40)]
    got = {(r.i, r.j): r.avg for r in clusters.mean_jaccard(spark.createDataFrame(rows, "cluster int, id int, items array<int>"), cap=9).collect()}
    kept = {c: [set(s) for k, _, s in rows if k == c][:9] for c in range(3)}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i in range(3):
        for j in range(i, 3):
            if i == j:
                pairs = [like(a, b) for x, a in enumerate(kept[i]) for b in kept[i][x + 1:]]
                want = sum(pairs) / (0.001 + len(pairs))
            else:
                pairs = [like(a, b) for a in kept[i] for b in kept[j]]
                want = sum(pairs) / (len(pairs) + 0.0001)
            assert got[i, j] == pytest.approx(want)


def test_beam_keeps_finished_ones(spark):
    starts = spark.createDataFrame([(1, "s", "s", 0.0, 1, True)], "pid bigint, last string, seq string, logp double, length int, rolling boolean")
    steps = spark.createDataFrame([(1, "s", "end", -0.1), (1, "s", "a", -0.5), (1, "a", "end", -0.2), (1, "a", "a", -3.0)], "pid bigint, last string, token string, ln_prob double")
    out = beam.beam_search(starts, steps, 2, "end", 10).orderBy("rank").collect()
    assert [r.seq for r in out] == ["s>end", "s>a>end"]
    assert out[0].logp == pytest.approx(-0.1 / 2**0.7, abs=1e-8)


def test_constructor_lookup(spark):
    types = spark.createDataFrame([("java.io.File",), ("none",)], "type string")
    apis = spark.createDataFrame([("java.io.FileReader()", 1), ("java.io.File()", 2)], "api string, id long")
    assert [(r.type, r.api) for r in checks.constructors_for(types, apis).collect()] == [("java.io.File", "java.io.FileReader()")]


def test_envelopes_lists_and_options(spark, tmp_path):
    record = {"file": "a.java", "method": "f@1", "body": "x @synthesize", "ast": '{"_nodes":[{"node":"DReturnVar"}]}', "returnType": None}
    (tmp_path / "a.json").write_text(json.dumps({"programs": [record, dict(record, method="g@2", ast=None)]}))
    (tmp_path / "bad.json").write_text('{"programs": [')
    listing = tmp_path / "list.txt"
    listing.write_text(f"{tmp_path}/a.json\n{tmp_path}/bad.json\n")
    rows = src.scan_envelopes(spark, src.listed_paths(spark, str(listing)))
    assert sorted(r.method for r in rows.collect()) == ["f@1", "g@2"]
    assert [r.method for r in src.marked(src.has_body(src.has_ast(rows))).collect()] == ["f@1"]
    assert "formal_params" in src.manipulated(rows).columns
    with pytest.raises(ValueError):
        src.one_source(spark)
    assert src.one_source(spark, records=[{"file": "x"}], schema="file string").count() == 1
    merged, size = src.merge(rows, rows)
    assert size.first()["size"] == 4 and merged.count() == 4
    (tmp_path / "o.json").write_text('{"seed": 5, "reader": {"max_loops": 3}}')
    options = stores.read_options(str(tmp_path / "o.json"))
    assert (options.seed, options.max_loops, options.max_nodes) == (5, 3, 64)
    (tmp_path / "p.json").write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        stores.read_options(str(tmp_path / "p.json"))
    allow = stores.allow_list(spark, {"api-packages": ["java.sql"], "api-classes": ["a.B"]})
    assert {(r.level, r.name) for r in allow.collect()} == {("package", "java.sql"), ("class", "a.B")}


def test_batch_iterator_and_lookup(spark):
    rows = ranking.whole_batches(spark.range(64), 16, 12, "id")
    assert [r.pos for r in stores.batch_rows(rows, 1)] == list(range(16, 32))
    assert stores.point_lookup(rows.withColumnRenamed("id", "pid"), 7).count() == 1


def test_parallel_text_is_aligned(spark, tmp_path):
    rows = src.file_chunks(spark.range(50).withColumn("t", F.concat(F.lit("line\n"), F.col("id").cast("string"))), "id", 20)
    stores.write_parallel_text(rows, F.col("t"), F.col("id").cast("string"), "id", str(tmp_path / "out"))
    for chunk in (0, 1, 2):
        read = lambda name: next((tmp_path / "out" / name / f"chunk={chunk}").glob("part-*")).read_text().splitlines()
        assert [b.split()[-1] for b in read("body")] == read("context")


def test_stream_of_programs(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"file": "f", "method": "m"}\n{"file": "f", "method": "m"}\n')
    stream = ingest.watch_programs(spark, str(inbox), "file string, method string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    out = ingest.run_append(ingest.without_repeats(stream, "ts", ["file", "method"], "1 hour"), "programs")
    assert out.count() == 1


def test_progress_reports_each_step():
    told = []
    progress = ingest.Progress(step=1000, report=told.append)

    class Event:
        class progress:
            numInputRows = 600

    for _ in range(4):
        progress.onQueryProgress(Event)
    assert told == ["records processed: 1200", "records processed: 2400"]


def test_shared_folder_comes_from_the_session():
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://shared/work/" if key == "spark.checkpoint.dir" else default

    assert new_folder(Named, "x").startswith("hdfs://shared/work/x-")


def test_large_envelopes_in_splits(spark, tmp_path):
    """Records over many splits, borders inside strings, records that are cut, a file that is no envelope."""
    records = [{"file": f"f{i}", "method": '{"file":', "body": 'x{"file":"y"},\\"{"file":' * (i % 50) + "]}", "formalParam": [{"node": "a"}]} for i in range(400)]
    texts = [json.dumps(r, separators=(",", ":")) for r in records]
    (tmp_path / "a.json").write_text('{"programs":[' + ",".join(texts) + "]}")
    (tmp_path / "b.json").write_text('{"size":3, "programs": [' + ",\n".join([texts[1], texts[2][:-9], texts[3]]) + "]\n}\n")
    (tmp_path / "c.json").write_text('{"programs":[' + texts[4] + "," + texts[5][:30])
    (tmp_path / "d.json").write_text("no envelope")
    (tmp_path / "e.json").write_text('{"programs":[]}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        good, bad = src.scan_large_envelopes(spark, str(tmp_path))
        got = Counter((r["file"], r["body"], r["_path"][-6:]) for r in good.collect())
        rejects = sorted((r["_path"][-6:], r["_corrupt"][:5]) for r in bad.collect())
        assert good.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = Counter((r["file"], r["body"], "a.json") for r in records)
    want += Counter((records[i]["file"], records[i]["body"], name) for i, name in ((1, "b.json"), (3, "b.json"), (4, "c.json")))
    assert got == want
    assert rejects == [("b.json", '"f2",'), ("c.json", '"f5",'), ("d.json", "no en")]
