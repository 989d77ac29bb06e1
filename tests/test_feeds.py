"""Files that belong together by line, and batches read from any place on."""

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeloom.session import new_folder
from codeloom.sources import aligned, epochs

NAMES = ["body", "context"]


def write(spark, rows, lines_per_file=3):
    path = new_folder(spark, "aligned")
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    aligned.write_aligned(frame, {"body": F.col("a"), "context": F.col("b")}, "id", path, lines_per_file)
    return path


def test_lines_belong_together(spark):
    rows = [(i, f"body {i}\r\nsecond", f"context {i}") for i in range(10)] + [(3, "", None), (3, "", None), (None, "no id", ""), (40, "long " * 50_000, "é x")]
    path = write(spark, rows)
    got = aligned.read_aligned(spark, path, NAMES).orderBy("chunk", "line").collect()
    want = sorted(((-1 if i is None else i), (a or "").replace("\r\n", " "), b or "") for i, a, b in rows)
    assert [(r.body, r.context) for r in got] == [(a, b) for _, a, b in want]
    assert [(r.chunk, r.line) for r in got] == [divmod(n, 3) for n in range(len(rows))]
    assert aligned.misaligned(spark, path, NAMES).count() == 0


def test_files_that_changed_are_found(spark):
    path = write(spark, [(i, f"b{i}", f"c{i}") for i in range(9)])
    spark.createDataFrame([("more",)], "value string").write.mode("append").text(f"{path}/body/chunk=1")
    spark.createDataFrame([("more",)], "value string").write.text(f"{path}/context/chunk=7")
    assert sorted(r.chunk for r in aligned.misaligned(spark, path, NAMES).collect()) == [1, 7]
    with pytest.raises(AnalysisException):
        aligned.misaligned(spark, f"{path}/body", NAMES)


def feed(spark, n=205, most=None, epochs_=3):
    path = new_folder(spark, "epochs")
    epochs.write_epochs(spark.range(n).withColumn("text", F.lit("t")), path, epochs_, 2, 7, "id", most)
    return epochs.EpochFeed(spark, path)


def ids(batch):
    return pd.DataFrame({"epoch": [batch["epoch"][0]], "batch_id": [batch["batch_id"][0]], "ids": [list(batch["id"])]})


SCHEMA = "epoch int, batch_id long, ids array<long>"


def test_resumed_equals_uninterrupted(spark):
    whole = feed(spark)
    assert (whole.epochs, whole.batches, whole.batch_size) == (3, 102, 2)
    order = lambda rows: sorted((r.epoch, r.batch_id, r.ids) for r in rows.collect())
    once = order(whole.each(ids, SCHEMA))
    assert [(e, b) for e, b, _ in once] == [(e, b) for e in range(3) for b in range(102)]
    for e in range(3):
        seen = [i for at, _, two in once if at == e for i in two]
        assert len(set(seen)) == 204 and seen != sorted(seen)
    parts, reader = [], "r"
    whole.keep_place(reader, (0, 0))
    while whole.place(reader) < (3, 0):
        again = epochs.EpochFeed(spark, whole.path)
        here = again.place(reader)
        parts += order(again.each(ids, SCHEMA, here, 130))
        again.keep_place(reader, again.after(here, 130))
    assert parts == once


def test_only_the_rest_is_opened(spark):
    whole = feed(spark)
    rest = whole.rows((2, 70))
    assert len(rest.select("epoch", "shard").distinct().collect()) == 1
    assert rest.count() == 2 * 32 and whole.rows((0, 1), 0).count() == 0
    pruned = next(line for line in rest._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "shard" in pruned.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_too_few_rows_and_caps(spark):
    assert feed(spark, most=5).batches == 5
    with pytest.raises(ValueError):
        feed(spark, n=1)
    with pytest.raises(ValueError):
        epochs.write_epochs(spark.range(9).withColumn("pos", F.lit(1)), new_folder(spark, "epochs"), 1, 2, 7, "id")
