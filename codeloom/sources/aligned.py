"""Text files that belong together line by line, such as bodies and their contexts.

Line n of a chunk's file under one name belongs to line n of the same chunk under every other name. Which row
stands where is decided once and stored; each file is then written from that table, so a task that runs again writes the
same lines. An index of line counts and digests comes last: an output without it is not complete.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.operators.ranking import positions
from codeloom.session import persist_table

ID_BLOCK = 1024


def _digest(value: Column) -> Column:
    """One md5 for a chunk's lines in order; a chunk has a fixed number of them."""
    lines = F.array_sort(F.collect_list(F.struct("line", F.md5(value).alias("h"))))
    return F.md5(F.array_join(F.transform(lines, lambda x: x["h"]), ""))


def _index(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    return lines.groupBy("chunk").agg(F.count(F.lit(1)).alias("lines"), *[_digest(F.col(n)).alias(f"md5_{n}") for n in names])


def write_aligned(rows: DataFrame, texts: Mapping[str, Column], id_col: str, path: str, lines_per_file: int) -> None:
    """A text file for each chunk of ``lines_per_file`` rows and each name, in order of a whole number ``id_col`` (null first), then of the texts.

    Line breaks inside a text become a space, null an empty line. Texts are moved once to find their places and once for each file.
    """
    names = list(texts)
    plain = rows.select(F.col(id_col).alias("_id"), *[F.coalesce(F.regexp_replace(c, "[\r\n]+", " "), F.lit("")).alias(n) for n, c in texts.items()])
    placed = positions(plain, [F.col("_id"), *[F.col(n) for n in names]], F.floor(F.col("_id") / ID_BLOCK), out="_pos")
    chunk, line = F.floor(F.col("_pos") / lines_per_file).cast("int"), (F.col("_pos") % lines_per_file).cast("int")
    stored = persist_table(placed.select(chunk.alias("chunk"), line.alias("line"), *names), "aligned")
    for name in names:
        in_order = stored.select("chunk", "line", F.col(name).alias("value")).repartition("chunk").sortWithinPartitions("chunk", "line")
        in_order.select("chunk", "value").write.partitionBy("chunk").option("lineSep", "\n").text(f"{path}/{name}")
    _index(stored, names).write.parquet(f"{path}/index")


def read_aligned(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """``chunk, line`` and a column for each name, from the files. A chunk's file is read as a whole, so that its lines have numbers."""
    out = None
    for name in names:
        files = spark.read.schema("value string, chunk int").text(f"{path}/{name}", wholetext=True)
        lines = F.split("value", "\n")
        one = files.select("chunk", F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("line", name))
        out = one if out is None else out.join(one, ["chunk", "line"], "full")
    return out


def misaligned(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Chunks whose files are not what the index says, missing and unknown ones included; fails where there is no index."""
    said = spark.read.parquet(f"{path}/index")
    found = _index(read_aligned(spark, path, names), names)
    same = F.lit(True)
    for c in said.columns[1:]:
        same = same & said[c].eqNullSafe(found[c])
    both = said.join(found, said["chunk"] == found["chunk"], "full")
    return both.where(~same | said["chunk"].isNull() | found["chunk"].isNull()).select(F.coalesce(said["chunk"], found["chunk"]).alias("chunk"))
