"""Static checks of programs: types, liveness, iterators, outcomes and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions.scores import rates_with_blanks
from codeloom.operators import scope as sc
from codeloom.session import persist_table

# Ids that never break the type rule of a role.
EXEMPT = {"expr": ("system_package", "LITERAL"), "ret": ("no_return_var",), "arg": ("LITERAL",)}
# Reasons given for a failed program, in the order they are looked for.
OUTCOMES = (
    ("void", "is void"), ("undeclared", "has undeclared var"), ("null", "has nullptr"), ("type", "has mismatched type"),
    ("no_return", "has no return statement"), ("unused", "has unused variable"),
)
TYPED = ("expr", "ret", "arg")


def learn_compat(resolved: DataFrame) -> DataFrame:
    """Distinct ``role, declared, usage`` seen in correct programs."""
    ok = resolved.where(F.col("found") & F.col("role").isin(*TYPED) & ~exempt())
    return ok.select("role", "declared", "usage").distinct()


def exempt() -> Column:
    out = F.lit(False)
    for role, ids in EXEMPT.items():
        out = out | ((F.col("role") == role) & F.col("var_id").isin(*ids))
    return out


def compat_violations(resolved: DataFrame, compat: DataFrame) -> DataFrame:
    """Typed uses of declared variables whose (role, declared, usage) was never seen."""
    typed = resolved.where(F.col("found") & F.col("role").isin(*TYPED) & ~exempt())
    return typed.join(compat, ["role", "declared", "usage"], "left_anti")


def seen_nowhere_else(resolved: DataFrame) -> DataFrame:
    """Typed uses of declared variables whose (role, declared, usage) no other program has.

    The relation is learned from all programs; a program is held against what the others show.
    """
    typed = resolved.where(F.col("found") & F.col("role").isin(*TYPED) & ~exempt())
    where = typed.groupBy("role", "declared", "usage").agg(F.min("pid").alias("_a"), F.max("pid").alias("_b"))
    alone = where.where("_a = _b").drop("_a", "_b")
    same = [typed[c].eqNullSafe(alone[c]) for c in ("role", "declared", "usage")]
    return typed.join(alone, same, "left_semi")


def unused_variables(declared: DataFrame, used: DataFrame) -> DataFrame:
    return declared.select("pid", "var_id").distinct().join(used.select("pid", "var_id").distinct(), ["pid", "var_id"], "left_anti")


def object_initialisation(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """``pid, var_id, initialised`` for class-typed declarations that are used or initialised."""
    objects = nodes.where(F.col("tag") == "DVarDeclCls").select("pid", "var_id").distinct()
    started = nodes.where(F.col("tag").isin("DClsInit", "DAPIInvoke")).select("pid", F.coalesce("ret_id", "var_id").alias("var_id"))
    touched = used.select("pid", "var_id").distinct().withColumn("_u", F.lit(True))
    both = objects.join(started.distinct().withColumn("_i", F.lit(True)), ["pid", "var_id"], "left").join(touched, ["pid", "var_id"], "left")
    return both.where("_i or _u").select("pid", "var_id", F.coalesce("_i", F.lit(False)).alias("initialised"))


def iterator_guard(calls: DataFrame) -> DataFrame:
    """``next`` calls with ``guarded``: an earlier ``hasNext`` in the same context, or in the condition it hangs on.

    ``calls``: pid, ctx, at, which. Only the first ``hasNext`` of a context matters, so each
    context comes down to one row before the join.
    """
    first = calls.where("which = 'hasNext'").groupBy("pid", "ctx").agg(F.min("at").alias("first_at"))
    wanted = calls.where("which = 'next'").withColumn("parent", F.regexp_replace("ctx", r"\.(then|else|body)$", ".cond"))
    own = wanted.join(first, ["pid", "ctx"], "left")
    parents = first.select("pid", F.col("ctx").alias("parent"), F.col("first_at").alias("parent_at"))
    both = own.join(parents, ["pid", "parent"], "left")
    at = F.col("at")
    return both.withColumn("guarded", F.coalesce(F.col("first_at") <= at, F.lit(False)) | F.coalesce(F.col("parent_at") <= at, F.lit(False)))


def constructors_for(types: DataFrame, apis: DataFrame) -> DataFrame:
    """``type, api``: the API with the least ``id`` (then text) among those whose text starts with the type; types without one have no row.

    In the order of their texts the APIs that start with a type follow it in one run, and a type that stands between
    them starts with it too. So one scan over both gives each API the last type before it, and only that type and
    the types that it starts with can be the API's; these are few. The scan goes by ranges of texts, each of which takes over
    the last type of the ranges before. Null texts take no part.
    """
    asked = types.where(F.col("type").isNotNull()).select("type").distinct()
    known = apis.where(F.col("api").isNotNull()).groupBy("api").agg(F.min("id").alias("id"))
    both = asked.select(F.col("type").alias("_text"), F.lit(0).alias("_kind"), F.lit(None).cast(known.schema["id"].dataType).alias("id")).unionByName(
        known.select(F.col("api").alias("_text"), F.lit(1).alias("_kind"), "id"))
    ranges = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = persist_table(both.repartitionByRange(ranges, "_text", "_kind").withColumn("_range", F.spark_partition_id()), "ranges")
    own_type = F.when(F.col("_kind") == 0, F.col("_text"))
    scan = W.partitionBy("_range").orderBy("_text", "_kind").rowsBetween(W.unboundedPreceding, 0)
    inside = dealt.withColumn("_near", F.last(own_type, ignorenulls=True).over(scan)).where("_kind = 1")
    lasts = dealt.groupBy("_range").agg(F.max(own_type).alias("_last"))
    carried = lasts.select(F.col("_range").alias("_at"), F.max("_last").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))  # one row for each range
    near = inside.join(carried, F.col("_range") == F.col("_at")).select(F.col("_text").alias("api"), "id", F.coalesce("_near", "_carry").alias("_near")).where("_near is not null")
    starts = asked.select(F.col("type").alias("_near"), F.explode(F.expr("transform(sequence(0, length(type)), n -> substring(type, 1, n))")).alias("type"))
    chains = starts.join(asked, "type", "left_semi").groupBy("_near").agg(F.collect_list("type").alias("_chain"))
    fits = near.join(chains, "_near").select("api", "id", F.explode(F.filter("_chain", lambda t: F.col("api").startswith(t))).alias("type"))
    return fits.groupBy("type").agg(F.min(F.struct("id", "api"))["api"].alias("api"))


def allowed_calls(calls: DataFrame, allow: DataFrame) -> DataFrame:
    """Calls whose module, package or class (without generics) is on the list ``level, name``."""
    qualified = F.regexp_replace("api", r"^\$.*\$", "")
    owner = F.regexp_replace(F.regexp_replace(F.substring_index(qualified, "(", 1), "<.*>", ""), r"\.[^.]*$", "")
    names = F.array(
        F.struct(F.lit("module").alias("level"), F.substring_index(owner, ".", 1).alias("name")),
        F.struct(F.lit("package").alias("level"), F.regexp_replace(owner, r"\.[^.]*$", "").alias("name")),
        F.struct(F.lit("class").alias("level"), owner.alias("name")),
    )
    strings = calls.select("api").distinct().withColumn("_q", F.explode(names)).select("api", "_q.level", "_q.name")
    good = strings.join(allow, ["level", "name"], "left_semi").select("api").distinct()
    return calls.join(good, "api", "left_semi")


def program_flags(nodes: DataFrame, resolved: DataFrame, violations: DataFrame, return_types: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per program with a flag per failure and its number of statements; ``violations``: uses of a wrong type."""
    base = nodes.groupBy("pid").agg(
        F.count(F.lit(1)).alias("statements"), (~F.bool_or(F.col("tag") == "DAPIInvoke")).alias("void"), F.bool_or(F.col("tag") == "DReturnVar").alias("returns_"),
    )
    missing = sc.undeclared(resolved)
    bad = missing.groupBy("pid").agg(F.bool_or(F.col("role") != "ret").alias("undeclared"), F.bool_or(F.col("role") == "ret").alias("null"))
    wrong = violations.select("pid").distinct().withColumn("type", F.lit(True))
    idle = unused_variables(declared, resolved).select("pid").distinct().withColumn("unused", F.lit(True))
    joined = base.join(return_types, "pid").join(bad, "pid", "left").join(wrong, "pid", "left").join(idle, "pid", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("undeclared", "null", "type", "unused")]
    needs = ~F.col("return_type").isin("void", "__delim__")
    return joined.select("pid", "statements", "void", *flags, (needs & ~F.col("returns_")).alias("no_return"))


def outcome() -> Column:
    chain = None
    for flag, text in OUTCOMES:
        said = F.lit(f"This program failed because it {text}")
        chain = F.when(F.col(flag), said) if chain is None else chain.when(F.col(flag), said)
    return chain.otherwise(F.lit("This program passed"))


def outcome_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy(outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("programs"))


def use_rates(resolved: DataFrame, violations: DataFrame) -> DataFrame:
    """Per role: passed, blank and failed uses and the three rates."""
    keys = ["pid", "node_id", "use_no"]
    marked = resolved.where(F.col("role").isin(*TYPED)).join(violations.select(*keys).withColumn("_bad", F.lit(True)), keys, "left")
    failed = F.coalesce("_bad", F.lit(False)) | (~F.col("found") & ~exempt())
    per = marked.groupBy("role").agg(
        F.count_if(~failed).alias("passed"), F.count_if(~failed & exempt()).alias("blank"), F.count_if(failed).alias("failed")
    )
    share, blank, effective = rates_with_blanks(F.col("passed"), F.col("blank"), F.col("failed"))
    return per.select("role", "passed", "blank", "failed", share.alias("pct"), blank.alias("pct_blank"), effective.alias("pct_effective"))


def failure_histogram(flags: DataFrame) -> DataFrame:
    """``kind, length, n, pct``: failures by program length as shares of their kind."""
    kinds = F.array(*[F.when(F.col(f), F.lit(f)) for f, _ in OUTCOMES])
    long = flags.select("statements", F.explode(F.array_compact(kinds)).alias("kind"))
    counts = long.groupBy("kind", F.col("statements").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "kind").select("kind", "length", "n", (F.col("n") / F.col("_t") * 100).alias("pct"))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """First rule broken, in order; null if none."""
    chain = None
    for name, broken in rules:
        chain = F.when(broken, F.lit(name)) if chain is None else chain.when(broken, F.lit(name))
    return chain


def split_rejects(programs: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = programs.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
