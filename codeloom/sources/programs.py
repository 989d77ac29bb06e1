"""Program records in files: scan, keep bad records aside, chunk, merge, gather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codeloom.operators.ranking import positions

NODE = "struct<node:string,_call:string,_id:string,_returns:string>"
PROGRAM = (
    "file string, method string, body string, javaDoc string, className string, returnType string, "
    f"formalParam array<{NODE}>, ast string, field_ast string"
)
CORRUPT = "_corrupt"


def listed_paths(spark: SparkSession, list_file: str) -> list[str]:
    """Paths in a list file, one per line. A list of input paths is small and fits the driver."""
    lines = spark.read.text(list_file).where(F.trim("value") != "")
    return [r["value"].strip() for r in lines.toLocalIterator()]


def scan_envelopes(spark: SparkSession, paths: str | Sequence[str], schema: str = PROGRAM) -> DataFrame:
    """Files of the form ``{"programs": [...]}``; missing and unreadable files are passed over."""
    envelope = T.StructType([T.StructField("programs", T.ArrayType(T.StructType.fromDDL(schema)))])
    reader = spark.read.schema(envelope).option("multiLine", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.json(paths).select(F.explode("programs").alias("p")).select("p.*")


def scan_large_envelopes(spark: SparkSession, paths: str | Sequence[str], schema: str = PROGRAM, border: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Envelope files of any size: (records, with the ``file`` they are from as ``_path``; rejects: ``_path, _block, _corrupt``).

    Files are split into byte ranges at the ``border``, the text that a record begins with: a brace and its first key,
    ``{"file":`` as the schema says. Inside a JSON string quotes are escaped, so it cannot stand there; a file needs
    no memory beyond its longest record, and many tasks read one file. A record that was cut or does not parse is
    a reject, with its file and the byte at which its split begins, and the records after it are read. What stands
    before the first border must be the envelope's head (or all of an empty one), else it is a reject. Missing and unreadable files are passed over.
    """
    full = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    border = border or f'{{"{full.fieldNames()[0]}":'
    head = r'^\s*(\{\s*("size"\s*:\s*\d+\s*,\s*)?"programs"\s*:\s*\[\s*(\]\s*(,\s*"size"\s*:\s*\d+\s*)?\}\s*)?)?$'
    tail = r'\s*(,|\]\s*(,\s*"size"\s*:\s*\d+\s*)?\})?\s*$'
    reader = spark.read.option("lineSep", border).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    parts = reader.text(paths).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = F.concat(F.lit(border), F.regexp_replace("value", tail, ""))
    whole = text.endswith("}")  # the parser does not look beyond a record, so its end is checked here
    parsed = parts.where(~F.col("value").rlike(head)).select("_path", "_block", "value", F.when(whole, F.from_json(text, full, options)).alias("r"))
    good = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()
    return parsed.where(good).select("r.*", "_path").drop(CORRUPT), parsed.where(~good).select("_path", "_block", F.col("value").alias(CORRUPT))


def scan_lines(spark: SparkSession, paths: str | Sequence[str], schema: str = PROGRAM) -> tuple[DataFrame, DataFrame]:
    """One record per line: (good records, bad lines). A blank line is a bad one."""
    full = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    lines = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths)
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull() | ~F.col("value").rlike(r"\S")
    return parsed.where(~bad).select("r.*").drop(CORRUPT), parsed.where(bad).select(F.col("value").alias(CORRUPT))


def from_records(spark: SparkSession, records: list[dict], schema: str = PROGRAM) -> DataFrame:
    """The same records from memory."""
    return spark.createDataFrame(records, schema)


def one_source(spark: SparkSession, path: str | None = None, records: list[dict] | None = None, schema: str = PROGRAM) -> DataFrame:
    if (path is None) == (records is None):
        raise ValueError("give either a path or records")
    return from_records(spark, records, schema) if path is None else scan_lines(spark, path, schema)[0]


def output_name(path: Column, root: str, prefix: str = "", suffix: str = "") -> Column:
    """Flat file name of a path: a leading dot becomes the root, slashes become underscores."""
    rooted = F.regexp_replace(path, r"^\.", root)
    return F.concat(F.lit(prefix), F.regexp_replace(rooted, "/", "_"), F.lit(suffix))


def has_ast(programs: DataFrame) -> DataFrame:
    return programs.where(F.col("ast").isNotNull())


def has_body(programs: DataFrame) -> DataFrame:
    """Programs whose tree has at least one statement."""
    return programs.where(F.coalesce(F.size(F.from_json("ast", "struct<_nodes:array<string>>")["_nodes"]), F.lit(0)) > 0)


def marked(programs: DataFrame, marker: str = "@synthesize") -> DataFrame:
    return programs.where(F.col("body").contains(marker))


def manipulated(programs: DataFrame, repair: bool = True, inferred: str = "inferred_return") -> DataFrame:
    """Column names of prepared records; the return type is the inferred one when repairing."""
    out = programs.withColumnRenamed("formalParam", "formal_params")
    source = F.col(inferred) if repair and inferred in out.columns else F.col("returnType")
    return out.withColumn("return_type", source).drop("returnType", inferred)


def write_chunks(programs: DataFrame, path: str, chunk: str = "chunk") -> None:
    """One folder per chunk. Rows are spread within a chunk, so no chunk goes through one task."""
    programs.write.partitionBy(chunk).json(path)


def gather_chunks(spark: SparkSession, path: str, schema: str, chunk: str = "chunk") -> DataFrame:
    return spark.read.schema(f"{schema}, {chunk} int").json(path)


def merge(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all records, one row with their ``size``)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, out.agg(F.count(F.lit(1)).alias("size"))


def file_chunks(rows: DataFrame, id_col: str, rows_per_file: int) -> DataFrame:
    """``chunk``: consecutive ids in files of a fixed number of rows."""
    placed = positions(rows, [F.col(id_col)], F.floor(F.col(id_col) / 1024), out="_pos")
    return placed.withColumn("chunk", F.floor(F.col("_pos") / rows_per_file).cast("int")).drop("_pos")
