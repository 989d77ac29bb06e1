"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Skewed join partitions are split by AQE even where
# that costs one more shuffle: a hot key may hold a third of the rows.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small inputs keep all cores busy; large ones are cut by size as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def build_session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a fresh temporary folder; on a cluster it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def persist_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As :func:`persist_table`, in files by the hash of ``key``: what is read back is dealt by it, so grouping, windows and joins by it shuffle nothing.

    Rows should be dealt by ``key`` to as many partitions already, so that each writes one file and nothing is sorted; others are written
    right as well. Without ``buckets`` it is :func:`persist_table`. The files belong to a name of the catalog only until they are known; the name goes, the files stay.
    """
    if not buckets:
        return persist_table(df, name)
    spark, path, known = df.sparkSession, new_folder(df.sparkSession, name), f"codeloom_{uuid.uuid4().hex}"
    setting = "spark.sql.maxConcurrentOutputFileWriters"  # without it rows are sorted by bucket first
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "8")
    try:
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(known)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    stored = spark.table(known)
    stored.schema  # resolved while the name is known
    spark.sql(f"drop table {known}")
    return stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
