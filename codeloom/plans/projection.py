"""Program records drawn from the given order tables.

A customer is a file, an order a method, its lines the calls. The calls' API text, argument
types, return types and variables come from the part, so every value is reproducible in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from codeloom.operators import trees
from codeloom.operators.ranking import positions
from codeloom.session import persist_buckets, table

BUCKET_LINES = 100_000  # lines of programs that are walked in one task, about
PART_LINES, PART_KEYS = 4096, 512  # a program of more lines is flattened in parts: by line number and so many part keys

PACKAGES = {"MEDIUM": "swing", "STANDARD": "awt", "LARGE": "sql", "PROMO": "net", "SMALL": "xml", "ECONOMY": "math"}
ARGS = ("", "int", "java.util.Map<java.lang.String,java.lang.Integer>,double", "org.acme.Foo,Tau_T")
RETURNS = ("void", "java.util.List<Tau_E>", "int")
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _choose(index: Column, values) -> Column:
    out = F.when(index == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        out = out.when(index == i, F.lit(value))
    return out


def api_columns() -> tuple[Column, Column]:
    """API text and return type of a part."""
    size = F.col("p_size")
    package = F.coalesce(*[F.when(F.col("p_type") == t, F.lit(p)) for t, p in PACKAGES.items()])
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.concat(first, F.upper(F.substring(second, 1, 1)), second.substr(F.lit(2), F.length(second)))
    api = F.concat(
        F.when(F.col("p_partkey") % 7 == 0, F.lit("$NOT$")).otherwise(F.lit("")),
        F.lit("java."), package, F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("")),
        F.when(size % 5 == 0, F.lit("<java.util.List<Tau_E>,java.lang.String>")).otherwise(F.lit("")),
        F.lit("."), name, F.lit("("), _choose(size % 4, ARGS), F.lit(")"),
    )
    return api, _choose(size % 3, RETURNS)


def apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    api, returns = api_columns()
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", api.alias("api"), returns.alias("returns"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call: ``pid``, its line columns, ``api`` and ``returns``."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pid")
    return lines.join(apis(spark, sf_dir).select("p_partkey", "api", "returns"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per method: ``pid``, ``file``, ``method``."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("pid"),
        F.col("o_custkey").alias("file"),
        F.concat(F.col("o_orderpriority"), F.lit("@"), F.col("o_orderkey").cast("string")).alias("method"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"),
    )


def _large_programs(lines: DataFrame, most: int | None = None) -> DataFrame | None:
    """The programs of more than ``most`` lines, None if there are none."""
    large = lines.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (most or PART_LINES)).select(F.col("pid").alias("_large"))
    return large if large.limit(1).count() else None


def in_parts(lines: DataFrame, most: int | None = None) -> DataFrame:
    """``part`` of each line: 0, but programs of more than ``most`` lines are dealt to parts along their order.

    Only the programs' sizes are counted (and combine before the shuffle); the few that are large are a small table. If there
    are none, no line has to meet it.
    """
    return _dealt(lines, _large_programs(lines, most))


def _dealt(lines: DataFrame, large: DataFrame | None) -> DataFrame:
    if large is None:
        return lines.withColumn("part", F.lit(0).cast("long"))
    place = F.col("l_linenumber").cast("long") * (1 << 40) + F.floor(F.col("l_partkey") / PART_KEYS)
    marked = lines.join(large, F.col("pid").eqNullSafe(F.col("_large")), "left")
    return marked.withColumn("part", F.when(F.col("_large").isNotNull(), place).otherwise(F.lit(0)).cast("long")).drop("_large")


def _part_texts(lines: DataFrame, node: Column) -> DataFrame:
    """``pid, part, ast``: the statements of each part as a JSON list."""
    rows = lines.select("pid", "part", *LINE_ORDER, node.alias("node"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "node"))), lambda s: s["node"]), ",")
    return rows.groupBy("pid", "part").agg(F.concat(F.lit("["), body, F.lit("]")).alias("ast"))


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """To how many tasks programs are dealt: by their lines, but all cores have one."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // BUCKET_LINES))


def _node_rows(
    spark: SparkSession, sf_dir: str, most: int | None, only: Sequence[str] | None, node: Callable[[], Column], change: Callable[[DataFrame], DataFrame] = lambda lines: lines,
) -> tuple[DataFrame, int]:
    """Node rows of programs, and to how many partitions their programs are dealt, 0 if they are not.

    Lines are dealt to their programs as they are, and become text where they meet. Only if a program is too large for
    that, texts are put together by parts. ``change``: what is done to the lines before.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pid")
    large = _large_programs(lines, most)
    called = apis(spark, sf_dir).select("p_partkey", "api", "returns")
    joined = change(_dealt(lines, large).join(called, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey"))
    if large is not None:
        return trees.flatten_parts(_part_texts(joined, node()), only), 0
    n = buckets(spark, sf_dir)
    place = F.xxhash64(*[value for c in LINE_ORDER for value in (F.col(c), F.col(c).isNull())])
    dealt = joined.withColumn("pid", F.col("pid").cast("bigint")).repartition(n, "pid").sortWithinPartitions("pid", *LINE_ORDER)
    return trees.flatten_lines(dealt.select("pid", place.alias("place"), node().alias("node")), only), n


def dealt_to(spark: SparkSession, sf_dir: str, most: int | None = None) -> int:
    """To how many partitions programs may be dealt as a whole: 0 if one is too large for that."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pid")
    return buckets(spark, sf_dir) if _large_programs(lines, most) is None else 0


def call_positions(lines: DataFrame, dealt: int = 0) -> DataFrame:
    """``pos`` of each call in its program; lines of one huge order spread over buckets.

    ``dealt``: to how many partitions programs go as a whole, if they do; rows of the same line then have the same place.
    """
    if dealt:
        inside = W.partitionBy("pid").orderBy(*line_order())
        return lines.repartition(dealt, "pid").withColumn("pos", F.rank().over(inside).cast("bigint") - 1)
    bucket = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 4096).alias("b"))
    return positions(lines, line_order(), bucket, keys=["pid"])


def line_order() -> list[Column]:
    return [F.col(c) for c in LINE_ORDER]


# --- syntax trees ----------------------------------------------------------------------
# A line becomes one or two statements by its return flag and status:
#   N/O  declaration of v, call into v          N/F  try {class declaration of v, construct v} catch (local_e)
#   R/O  if (call on v) {declare w, call into w}  R/F  if (true) {} else {return v}
#   A/O  while (call on v) {call on w}          A/F  while (true) {if (true) {call on v}}
# with v = var_<l_suppkey mod 7>, w = var_<l_partkey mod 7>.

def line_nodes() -> Column:
    def quote(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    v = F.concat(F.lit("var_"), (F.col("l_suppkey") % 7).cast("string"))
    w = F.concat(F.lit("var_"), (F.col("l_partkey") % 7).cast("string"))

    def invoke(expr: Column, ret: Column) -> Column:
        return F.concat(
            F.lit('{"node":"DAPIInvoke","_calls":[{"_call":'), quote(F.col("api")), F.lit(',"fp":['),
            F.when(F.col("api").endswith("()"), F.lit("")).otherwise(quote(w)), F.lit('],"_returns":'), quote(F.col("returns")),
            F.lit('}],"expr_var_id":'), quote(expr), F.lit(',"ret_var_id":'), quote(ret), F.lit(',"_returns":'), quote(F.col("returns")), F.lit("}"),
        )

    def declare(tag: str, name: Column) -> Column:
        return F.concat(F.lit(f'{{"node":"{tag}","_id":'), quote(name), F.lit(',"_returns":'), quote(F.col("returns")), F.lit("}"))

    none, static = F.lit("no_return_var"), F.lit("system_package")
    construct = F.concat(F.lit('{"node":"DClsInit","_id":'), quote(v), F.lit(',"_call":'), quote(F.col("api")), F.lit(',"fp":[],"_returns":'), quote(F.col("returns")), F.lit("}"))
    cases = {
        ("N", "O"): F.concat(declare("DVarDecl", v), F.lit(","), invoke(static, v)),
        ("N", "F"): F.concat(F.lit('{"node":"DExcept","_try":['), declare("DVarDeclCls", v), F.lit(","), construct,
                             F.lit('],"_catch":['), declare("DExceptionVar", F.lit("local_e")), F.lit("]}")),
        ("R", "O"): F.concat(F.lit('{"node":"DBranch","_cond":['), invoke(v, none), F.lit('],"_then":['), declare("DVarDecl", w),
                             F.lit(","), invoke(static, w), F.lit('],"_else":[]}')),
        ("R", "F"): F.concat(F.lit('{"node":"DBranch","_cond":[],"_then":[],"_else":['), declare("DReturnVar", v), F.lit("]}")),
        ("A", "O"): F.concat(F.lit('{"node":"DLoop","_cond":['), invoke(v, none), F.lit('],"_body":['), invoke(w, none), F.lit("]}")),
        ("A", "F"): F.concat(F.lit('{"node":"DLoop","_cond":[],"_body":[{"node":"DBranch","_cond":[],"_then":['), invoke(v, none), F.lit('],"_else":[]}]}')),
    }
    out = None
    for (flag, status), text in cases.items():
        hit = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def program_nodes(spark: SparkSession, sf_dir: str, most: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """The node table of all programs, whatever their size; ``only`` some of its columns."""
    return _node_rows(spark, sf_dir, most, only, line_nodes)[0]


def dealt_program_nodes(
    spark: SparkSession, sf_dir: str, only: Sequence[str] | None = None, most: int | None = None, node: Callable[[], Column] = line_nodes,
) -> tuple[DataFrame, int]:
    """As :func:`program_nodes`, not yet written, and to how many partitions programs are dealt (0: they are not)."""
    return _node_rows(spark, sf_dir, most, only, node)


def stored_program_nodes(
    spark: SparkSession, sf_dir: str, only: Sequence[str] | None = None, most: int | None = None, node: Callable[[], Column] = line_nodes,
) -> tuple[DataFrame, int]:
    """As :func:`program_nodes`, written, and dealt by program to so many buckets (0: not), so that steps that look at programs one by one need no shuffle."""
    rows, n = dealt_program_nodes(spark, sf_dir, only, most, node)
    return persist_buckets(rows, "nodes", "pid", n), n


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, ast``: one JSON tree per order, as a record of its own."""
    return _whole(calls(spark, sf_dir), line_nodes())


def _whole(lines: DataFrame, node: Column) -> DataFrame:
    whole = _part_texts(lines.withColumn("part", F.lit(0)), node)
    return whole.select("pid", F.concat(F.lit('{"node":"DSubTree","_nodes":'), "ast", F.lit("}")).alias("ast"))


# --- extracted (not yet lowered) trees ---------------------------------------------------
#   N/O  v = static call(w), then a call chained on it        N/F  try {v = new …} catch (e) {}
#   R/O  if (v.call(v.call())) {w declared} else {}           R/F  return static call
#   A/O  while (v.call()) {v declared; v = v.call(literal)}   A/F  an assignment, then v declared

def raw_line_nodes() -> Column:
    v = F.concat(F.lit('"var_'), (F.col("l_suppkey") % 7).cast("string"), F.lit('"'))
    w = F.concat(F.lit('"var_'), (F.col("l_partkey") % 7).cast("string"), F.lit('"'))
    api, returns = F.concat(F.lit('"'), F.col("api"), F.lit('"')), F.concat(F.lit('"'), F.col("returns"), F.lit('"'))

    def ref(name) -> Column:
        return F.concat(F.lit('{"node":"DVarCall","_id":'), name if isinstance(name, Column) else F.lit(name), F.lit("}"))

    def call(expr, ret, *args) -> Column:
        listed = F.concat_ws(",", *args) if args else F.lit("")
        return F.concat(F.lit('{"node":"DAPICall","_call":'), api, F.lit(',"expr_var_id":'), ref(expr), F.lit(',"fp_var_ids":['), listed,
                        F.lit('],"ret_var_id":'), ret, F.lit(',"_throws":[],"_returns":'), returns, F.lit("}"))

    def declare(tag: str, name) -> Column:
        return F.concat(F.lit(f'{{"node":"{tag}","_id":'), name, F.lit(',"_returns":'), returns, F.lit("}"))

    null, static, chain = F.lit("null"), '"system_package"', '"last_DAPICall"'
    make = F.concat(F.lit('{"node":"DClsInit","_call":'), api, F.lit(',"fp_var_ids":[],"_var":'), v, F.lit(',"_returns":'), returns, F.lit("}"))
    cases = {
        ("N", "O"): F.concat(call(static, v, ref(w)), F.lit(","), call(chain, null)),
        ("N", "F"): F.concat(F.lit('{"node":"DExcept","_try":['), make, F.lit('],"_catch":['), declare("DExceptionVar", F.lit('"local_e"')), F.lit("]}")),
        ("R", "O"): F.concat(F.lit('{"node":"DBranch","_cond":['), call(v, null, call(v, null)), F.lit('],"_then":['), declare("DVarCall", w), F.lit('],"_else":[]}')),
        ("R", "F"): F.concat(F.lit('{"node":"DReturnStmt","_stmt":['), call(static, null), F.lit("]}")),
        ("A", "O"): F.concat(F.lit('{"node":"DLoop","_cond":['), call(v, null), F.lit('],"_body":['), declare("DVarCall", v), F.lit(","), call(v, v, ref("null")), F.lit("]}")),
        ("A", "F"): F.concat(F.lit('{"node":"DAssign","_from":"a","_to":"b","_type":"int"},'), declare("DVarCall", v)),
    }
    out = None
    for (flag, status), text in cases.items():
        hit = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def raw_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(calls(spark, sf_dir), raw_line_nodes())


def raw_program_nodes(spark: SparkSession, sf_dir: str, most: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """The node table of all extracted programs; ``only`` some of its columns."""
    return _node_rows(spark, sf_dir, most, only, raw_line_nodes)[0]


# --- programs over iterators ---------------------------------------------------------------

ITERATOR = tuple(f"java.util.Iterator<java.lang.String>.{name}()" for name in ("hasNext", "next", "remove"))


def iterator_program_nodes(spark: SparkSession, sf_dir: str, most: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """As :func:`program_nodes`, where three of five suppliers stand for calls on an iterator."""
    kind = F.col("l_suppkey") % 5
    api = F.when(kind == 0, ITERATOR[0]).when(kind == 1, ITERATOR[1]).when(kind == 2, ITERATOR[2]).otherwise(F.col("api"))
    return _node_rows(spark, sf_dir, most, only, line_nodes, lambda lines: lines.withColumn("api", api))[0]
