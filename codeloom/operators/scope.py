"""Variables in scope: which declaration a use sees.

A declaration is seen by later nodes of its own scope and of the scopes inside it. So a use asks for the latest
declaration before it in each of the scopes round it, which are as many as it is nested deep: an as-of join
on (program, variable, scope), done as a scan in order of the nodes. Scans run over bins of a program's nodes,
and what holds at the beginning of a bin comes from the bins before it, so no program is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions.javatypes import expr_type, formal_types
from codeloom.operators.ranking import positions
from codeloom.session import persist_table

BIN = 4096  # nodes of a program that are scanned together
SHORT = 256  # nodes of a program that is looked at as a whole
BUILTIN = ("system_package", "LITERAL", "no_return_var")
DECLARING = ("DVarDecl", "DVarDeclCls", "DExceptionVar", "DFieldCall")


def declarations(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag").isin(*DECLARING)).select(
        "pid", "node_id", "var_id", "scope", "tag", F.col("returns").alias("declared")
    )


def _uses() -> Column:
    """The variables a node uses: receiver, target, arguments, returned value."""
    call, tag = F.get("calls", F.lit(0)), F.col("tag")

    def use(role: str, var: Column, usage: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), var.alias("var_id"), usage.alias("usage"))

    formal = formal_types(call["call"])
    args = F.transform(call["args"], lambda a, i: use("arg", a, F.get(formal, i)))
    owner = F.when(tag == "DAPIInvoke", use("expr", F.coalesce("expr_id", F.lit("system_package")), expr_type(call["call"])))
    target = use("ret", F.coalesce("ret_id", "var_id", F.lit("no_return_var")), F.col("returns"))
    returned = use("return", F.coalesce("var_id", F.lit("no_return_var")), F.col("returns"))
    return F.when(F.size("calls") > 0, F.array_compact(F.concat(F.array(owner, target), args))).when(
        tag == "DReturnVar", F.array(returned)
    )


def uses(nodes: DataFrame) -> DataFrame:
    """``pid, node_id, use_no, role, var_id, usage, scope``."""
    return nodes.select("pid", "node_id", "scope", F.posexplode(_uses()).alias("use_no", "x")).select(
        "pid", "node_id", "use_no", "x.role", "x.var_id", "x.usage", "scope"
    )


def sees(scope: Column, inner: Column) -> Column:
    """``inner`` is the scope itself or lies inside it."""
    return (scope == inner) | inner.startswith(F.concat(scope, F.lit("/")))


def enclosing(scope: Column) -> Column:
    """A scope and those round it, the outermost (empty) first."""
    parts = F.split(scope, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _in_bins(rows: DataFrame, at: str, bin_size: int) -> tuple[DataFrame, bool]:
    """The rows with ``_bin``, written, and whether any row stands beyond the first bin of its program."""
    stored = persist_table(rows.withColumn("_bin", F.floor(F.greatest(F.col(at), F.lit(0)) / bin_size)), "bins")
    return stored, bool(stored.where("_bin > 0").limit(1).count())


def latest_before(asked: DataFrame, known: DataFrame, keys: Sequence[str], at: str, value: str, bins_of: int = 1) -> DataFrame:
    """``asked`` with ``value``: that of the last row of ``known`` with the same keys and a smaller ``at``, else null.

    Keys and ``at`` are not null. Rows are scanned in bins of ``at``; a value that comes from an earlier bin is the last
    of the bins before, from a table with one row for each key and bin. Where there is one bin, nothing is carried.
    """
    rest = [c for c in asked.columns if c not in (*keys, at)]
    bin_size = bins_of * BIN
    a = asked.select(*keys, at, F.struct(*rest).alias("_rest"), F.lit(None).cast(known.schema[value].dataType).alias("_v"), F.lit(False).alias("_known"))
    b = known.select(*keys, at, F.lit(None).cast(a.schema["_rest"].dataType).alias("_rest"), F.col(value).alias("_v"), F.lit(True).alias("_known"))
    rows, carries = _in_bins(a.unionByName(b), at, bin_size)
    inside = W.partitionBy(*keys, "_bin").orderBy(at, "_known").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn(value, F.last("_v", ignorenulls=True).over(inside)).where("not _known")
    if carries:
        bins = rows.groupBy(*keys, "_bin").agg(F.max(F.when(F.col("_known"), F.struct(F.col(at).alias("at"), "_v"))).alias("_last"))
        before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        carried = bins.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)["_v"]).where("_carry is not null").select(*keys, "_bin", "_carry")
        found = found.join(carried, [*keys, "_bin"], "left").withColumn(value, F.coalesce(value, "_carry"))
    return found.select(*keys, at, value, *[F.col(f"_rest.{c}").alias(c) for c in rest])


def _resolved_together(nodes: DataFrame) -> DataFrame:
    """Uses with ``seen``, of programs that are short: each node is given its program's declarations, and looks for its own among them.

    One shuffle of nodes. A use is held against all declarations of its program, so this is for programs of at most ``SHORT`` nodes.
    """
    declares = F.col("tag").isin(*DECLARING) & F.col("var_id").isNotNull()
    taken = nodes.select("pid", "node_id", "scope", "tag", "calls", "var_id", "expr_id", "ret_id", "returns").where(
        F.col("tag").isin(*DECLARING, "DReturnVar") | (F.size("calls") > 0))
    known = F.collect_list(F.when(declares, F.struct(F.col("node_id").alias("at"), F.col("returns").alias("declared"), "var_id", "scope")))
    met = taken.withColumn("_known", known.over(W.partitionBy("pid"))).where((F.col("tag") == "DReturnVar") | (F.size("calls") > 0))
    visible = F.filter("_known", lambda d: (d["at"] < F.col("node_id")) & sees(d["scope"], F.col("scope")))
    each = met.select("pid", "node_id", "scope", visible.alias("_visible"), F.posexplode(_uses()).alias("use_no", "x"))
    own = F.filter("_visible", lambda d: d["var_id"] == F.col("x.var_id"))
    seen = F.when(~F.col("x.var_id").isin(*BUILTIN), F.array_max(F.transform(own, lambda d: F.struct(d["at"].alias("at"), d["declared"].alias("declared")))))
    return each.select("pid", "node_id", "use_no", "x.role", "x.var_id", "x.usage", "scope", seen.alias("seen"))


def _resolved_in_bins(nodes: DataFrame) -> DataFrame:
    """Uses with ``seen``, of programs of any size."""
    own = ["pid", "node_id", "use_no", "role", "var_id", "usage", "scope"]
    used = uses(nodes)
    builtin = F.col("var_id").isin(*BUILTIN) | F.col("var_id").isNull() | F.col("pid").isNull()
    nothing = F.lit(None).cast("struct<at:int,declared:string>")
    asked = used.where(~builtin).select(*own, F.explode(enclosing(F.col("scope"))).alias("_in"))
    known = declarations(nodes).where("pid is not null and var_id is not null").select(
        "pid", "var_id", F.col("scope").alias("_in"), "node_id", F.struct(F.col("node_id").alias("at"), "declared").alias("seen"))
    each = latest_before(asked, known, ["pid", "var_id", "_in"], "node_id", "seen")
    merged = each.groupBy("pid", "node_id", "use_no").agg(
        *[F.any_value(c).alias(c) for c in own[3:]], F.max("seen").alias("seen"))
    return merged.select(*own, "seen").unionByName(used.where(F.coalesce(builtin, F.lit(True))).select(*own, nothing.alias("seen")))


def by_length(nodes: DataFrame, short: Callable[[DataFrame], DataFrame], any_length: Callable[[DataFrame], DataFrame], beyond: Column | None = None) -> DataFrame:
    """``short`` of the programs of at most ``SHORT`` nodes, united with ``any_length`` of the rest and of nodes without a program.

    ``nodes`` are read twice, once for their ids only, and should be stored. ``beyond``: what only rows of long programs satisfy, if not their ``node_id``.
    """
    beyond = F.col("node_id") >= SHORT if beyond is None else beyond
    long = persist_table(nodes.where(beyond | F.col("pid").isNull()).select(F.col("pid").alias("_long")).distinct(), "long")
    if not long.limit(1).count():
        return short(nodes)
    same = F.col("pid").eqNullSafe(F.col("_long"))
    return short(nodes.join(long, same, "left_anti")).unionByName(any_length(nodes.join(long, same, "left_semi")))


def resolve_uses(nodes: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """Uses with ``declared`` (type of the latest visible declaration) and ``found``.

    ``given``: types of variables that are declared outside, before all else; inner declarations hide them.
    Short programs are looked at one by one, long ones in bins, with the same result.
    """
    own = ["pid", "node_id", "use_no", "role", "var_id", "usage", "scope"]
    rows = by_length(nodes, _resolved_together, _resolved_in_bins)
    outside = F.lit(None).cast("string")
    for name, kind in (given or {}).items():
        outside = F.when(F.col("var_id") == name, kind).otherwise(outside)
    return rows.select(
        *own, F.when(F.col("seen").isNotNull(), F.col("seen.declared")).otherwise(outside).alias("declared"), (F.col("seen").isNotNull() | outside.isNotNull()).alias("found"))


def undeclared(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.col("found") & ~F.col("var_id").isin(*BUILTIN))


def with_visible_counts(nodes: DataFrame, scopes: Column | None = None, **events: Column) -> DataFrame:
    """The nodes, each with how many earlier nodes of the enclosing scopes satisfy an event, for every event.

    ``scopes``: the scopes that a node looks into, if not those round it. Short programs are shuffled once, by program.
    """
    def together(some: DataFrame) -> DataFrame:
        whole, looks = W.partitionBy("pid"), enclosing(F.col("scope")) if scopes is None else scopes
        for name, event in events.items():
            some = some.withColumn(f"_at_{name}", F.collect_list(F.when(event, F.struct(F.col("node_id").alias("at"), "scope"))).over(whole))
        some = some.withColumn("_looks", looks)
        times = lambda d: F.size(F.filter("_looks", lambda s: s == d["scope"]))
        count = lambda name: F.aggregate(F.filter(f"_at_{name}", lambda d: d["at"] < F.col("node_id")), F.lit(0), lambda n, d: n + times(d))
        return some.select(*nodes.columns, *[count(name).alias(name) for name in events])

    return by_length(nodes, together, lambda some: some.join(_counts_in_bins(some, scopes, **events), ["pid", "node_id"]).select(*nodes.columns, *events))


def visible_counts(nodes: DataFrame, scopes: Column | None = None, **events: Column) -> DataFrame:
    """``pid, node_id`` and the counts of :func:`with_visible_counts`."""
    return with_visible_counts(nodes, scopes, **events).select("pid", "node_id", *events)


def _counts_in_bins(nodes: DataFrame, scopes: Column | None = None, **events: Column) -> DataFrame:
    """Counts in programs of any size: running sums along (program, scope), in bins, added up over a node's scopes."""
    names = list(events)
    flags = [e.cast("int").alias(name) for name, e in events.items()]
    looks = enclosing(F.col("scope")) if scopes is None else scopes
    row = lambda place, values, known: F.struct(place.alias("_in"), *values, F.lit(known).alias("_known"))
    zeros = [F.lit(0).alias(name) for name in names]
    asked = F.transform(looks, lambda s: row(s, zeros, False))
    own = F.when(sum((F.col(n) for n in names), F.lit(0)) > 0, F.array(row(F.col("scope"), [F.col(n) for n in names], True)))
    marked = nodes.select("pid", "node_id", "scope", *flags).select("pid", "node_id", F.explode(F.concat(asked, F.coalesce(own, F.slice(asked, 1, 0)))).alias("_r"))
    rows, carries = _in_bins(marked.select("pid", "node_id", "_r.*"), "node_id", BIN)
    inside = W.partitionBy("pid", "_in", "_bin").orderBy("node_id", "_known").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(n).over(inside).alias(f"_sum_{n}") for n in names]).where("not _known")
    if carries:
        bins = rows.groupBy("pid", "_in", "_bin").agg(*[F.sum(n).alias(f"_own_{n}") for n in names])
        before = W.partitionBy("pid", "_in").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        offsets = bins.select(F.col("pid").alias("_pid"), F.col("_in").alias("_at_in"), F.col("_bin").alias("_at_bin"), *[F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
        summed = summed.join(offsets, F.col("pid").eqNullSafe(F.col("_pid")) & (F.col("_in") == F.col("_at_in")) & (F.col("_bin") == F.col("_at_bin")))
        summed = summed.select("pid", "node_id", *[(F.col(f"_sum_{n}") + F.col(f"_before_{n}")).alias(f"_sum_{n}") for n in names])
    return summed.groupBy("pid", "node_id").agg(*[F.sum(f"_sum_{n}").cast("int").alias(n) for n in names])


def prune_unused(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Declarations no use refers to go; everything else stays."""
    names = used.select("pid", "var_id").distinct()
    is_decl = F.col("tag").isin(*DECLARING)
    return nodes.where(~is_decl).unionByName(nodes.where(is_decl).join(names, ["pid", "var_id"], "left_semi").select(*nodes.columns))


def rename_variables(declared: DataFrame, seed: int = 12, cap: int = 10) -> DataFrame:
    """``pid, var_id, mapped``: k-th variable of a program to ``var_<perm[k]>``; beyond the cap it keeps k."""
    first = declared.groupBy("pid", "var_id").agg(F.min("node_id").alias("at"))
    ranked = positions(first, [F.col("at"), F.col("var_id")], F.floor(F.col("at") / BIN), ["pid"], out="k").withColumn("k", F.col("k").cast("int"))
    order = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pid").cast("string"), i.cast("string"))).alias("h"), i.alias("i")),
    ))
    perm = F.transform(order, lambda s: s["i"])
    number = F.when(F.col("k") < cap, F.get(perm, F.col("k"))).otherwise(F.col("k"))
    return ranked.select("pid", "var_id", "k", F.concat(F.lit("var_"), number.cast("string")).alias("mapped"))
