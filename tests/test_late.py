"""Late and refused rows of a stream against a plain recount."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.session import new_folder
from codeloom.streaming.late import LateCounts

SCHEMA = "ts timestamp_ntz, what string, extra string"
START, HOUR = datetime(2024, 1, 1), timedelta(hours=1)


def at(hours):
    return START + timedelta(hours=hours)


def test_deliveries_out_of_order(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    deliveries = [
        [(at(0.5), "a", "x"), (at(1.5), "a", "x"), (at(5), "b", "x"), (None, "a", "x"), (at(0.2), None, "x")],
        [(at(0.9), "a", "x"), (at(4.5), "b", "x"), (at(9), "a", "bad"), (at(9), "b", "x"), (at(9), "b", "x")],
        [(None, "b", "bad"), (at(4.6), "b", "x"), (at(1.1), "a", "x"), (at(8.9), None, "x")],
        [(at(1.2), "a", "x")],
    ]
    folder = new_folder(spark, "rows")
    stream = LateCounts(spark, folder, spark.createDataFrame([], SCHEMA).schema, "ts", F.col("what"), "2 hours", HOUR, F.when(F.col("extra") == "bad", "bad"))
    windows, late, refused, newest = Counter(), Counter(), Counter(), None
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream.run()
        for ts, what, extra in rows:
            if ts is None or extra == "bad":
                refused["no time" if ts is None else "bad"] += 1
                continue
            start = START + (ts - START) // HOUR * HOUR
            behind = newest is not None and start + HOUR <= newest - 2 * HOUR
            (late if behind else windows)[what, start] += 1
        newest = max([newest or START, *[r[0] for r in rows if r[0]]])
    got = stream.result().collect()
    assert {(r.reason, r.start): r.n for r in got if r.kind in ("open", "closed")} == windows
    assert {(r.reason, r.start): r.n for r in got if r.kind == "late"} == late and len(late) == 3 and late["a", START + HOUR] == 2
    assert {r.reason: r.n for r in got if r.kind == "reject"} == refused
    closed = {(r.reason, r.start) for r in got if r.kind == "closed"}
    assert closed == {w for w in windows if w[1] + HOUR < newest - 2 * HOUR}
    whole = Counter((what, START + (ts - START) // HOUR * HOUR) for rows in deliveries for ts, what, extra in rows if ts and extra != "bad")
    assert windows + late == whole
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
