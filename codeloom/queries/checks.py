"""Rules and static checks over programs built from orders, and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import checks, labels, ranking, scope as sc, siblings, trees as tr
from codeloom.plans import projection as pj
from codeloom.queries.corpus import SIBLINGS
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import CALLS, LINE_ORDER, METHODS, PARTS, TREE
from codeloom.session import persist_buckets, persist_table, table
from codeloom.sources.stores import Options

# Each program has the parameters var_0, var_1 and var_3 of type int, and returns void if its id divides by 3.
PARAMETERS = ("var_0", "var_1", "var_3")

SCOPE = TREE + r""",
decls as (select pid, node_id, var_id, scope, tag, returns as declared from nodes where tag in ('DVarDecl', 'DVarDeclCls', 'DExceptionVar')
  union all select distinct pid, -1, p, '', 'DVarDecl', 'int' from nodes, (select unnest(['var_0', 'var_1', 'var_3']) as p)),
owner as (select *, replace(regexp_replace(split_part(call, '(', 1), '\.[^.]*$', ''), '$NOT$', '') as own,
  case when contains(call, '(int)') then 'int' when contains(call, '(java.util.Map') then 'java.util.Map<java.lang.String,java.lang.Integer>' when contains(call, '(org.acme') then 'org.acme.Foo' end as formal from nodes),
uses as (select pid, node_id, 0 as use_no, 'expr' as role, expr_id as var_id, own as usage, scope from owner where tag = 'DAPIInvoke'
  union all select pid, node_id, 1, 'ret', ret_id, returns, scope from owner where tag = 'DAPIInvoke'
  union all select pid, node_id, 2, 'arg', arg, formal, scope from owner where tag = 'DAPIInvoke' and arg is not null
  union all select pid, node_id, 0, 'ret', var_id, returns, scope from owner where tag = 'DClsInit'
  union all select pid, node_id, 0, 'return', var_id, returns, scope from owner where tag = 'DReturnVar'),
resolved as (select u.pid, u.node_id, u.use_no, u.role, u.var_id, any_value(u.usage) as usage, arg_max(d.declared, d.node_id) as declared, count(d.pid) > 0 as found
  from uses u left join decls d on d.pid = u.pid and d.var_id = u.var_id and d.node_id < u.node_id and (d.scope = u.scope or starts_with(u.scope, d.scope || '/'))
  group by u.pid, u.node_id, u.use_no, u.role, u.var_id),
typed as (select *, (role = 'expr' and var_id in ('system_package', 'LITERAL')) or (role = 'ret' and var_id = 'no_return_var') or (role = 'arg' and var_id = 'LITERAL') as exempt
  from resolved where role <> 'return'),
compat as (select role, declared, usage, min(pid) = max(pid) as once from typed where found and not exempt group by role, declared, usage),
violations as (select t.* from typed t join compat c on t.role = c.role and t.declared is not distinct from c.declared and t.usage is not distinct from c.usage where found and not exempt and once)"""


SCOPED = ("pid", "node_id", "scope", "tag", "calls", "var_id", "expr_id", "ret_id", "returns")  # what declarations and uses are read from


def dealt_nodes(spark, sf_dir, *more):
    return pj.stored_program_nodes(spark, sf_dir, (*SCOPED, *more))


def stored_nodes(spark, sf_dir, *more):
    return dealt_nodes(spark, sf_dir, *more)[0]


def all_declarations(nodes):
    given = nodes.select("pid").distinct().select(
        "pid", F.lit(-1).alias("node_id"), F.explode(F.array(*[F.lit(p) for p in PARAMETERS])).alias("var_id"),
        F.lit("").alias("scope"), F.lit("DVarDecl").alias("tag"), F.lit("int").alias("declared"),
    )
    return sc.declarations(nodes).unionByName(given)


GIVEN = dict.fromkeys(PARAMETERS, "int")


def uses_of_programs(spark, sf_dir):
    return sc.resolve_uses(stored_nodes(spark, sf_dir), GIVEN)


@query("undeclared_use", f"with {SCOPE} select pid, node_id, role, var_id from resolved where not found and var_id not in ('system_package', 'LITERAL', 'no_return_var')")
def undeclared_use(spark, sf_dir):
    """J6"""
    return sc.undeclared(uses_of_programs(spark, sf_dir)).select("pid", "node_id", "role", "var_id")


@query("scope_check", f"with {SCOPE} select role, count(*) filter (found) as passed, count(*) filter (not found) as failed from resolved where starts_with(var_id, 'var_') group by role")
def scope_check(spark, sf_dir):
    """By exact scope, not by a substring of the context."""
    used = uses_of_programs(spark, sf_dir).where(F.col("var_id").startswith("var_"))
    return used.groupBy("role").agg(F.count_if("found").alias("passed"), F.count_if(~F.col("found")).alias("failed"))


@query("declared_types", f"with {SCOPE} select pid, node_id, use_no, role, var_id, declared, usage from resolved where found")
def declared_types(spark, sf_dir):
    """The latest visible declaration of each use."""
    return uses_of_programs(spark, sf_dir).where("found").select("pid", "node_id", "use_no", "role", "var_id", "declared", "usage")


@query("visible_declarations", f"""with {TREE}, e as (select pid, node_id, scope, tag in ('DVarDecl', 'DVarDeclCls', 'DExceptionVar') as is_decl, tag = 'DReturnVar' as is_ret from nodes)
select n.pid, n.node_id, (count(*) filter (e.is_decl))::int as var_decl_id, coalesce(bool_or(e.is_ret), false) as return_reached
from nodes n left join e on e.pid = n.pid and e.node_id < n.node_id and (e.scope = n.scope or starts_with(n.scope, e.scope || '/')) group by n.pid, n.node_id""")
def visible_declarations(spark, sf_dir):
    """W6, W7"""
    counted = sc.visible_counts(
        pj.stored_program_nodes(spark, sf_dir, ("pid", "node_id", "scope", "tag"))[0], var_decl_id=F.col("tag").isin(*sc.DECLARING), returns=F.col("tag") == "DReturnVar"
    )
    return counted.select("pid", "node_id", "var_decl_id", (F.col("returns") > 0).alias("return_reached"))


@query("unused_decl", f"with {SCOPE} select distinct pid, var_id from decls d where not exists (select 1 from uses u where u.pid = d.pid and u.var_id = d.var_id)")
def unused_decl(spark, sf_dir):
    """A12"""
    nodes = stored_nodes(spark, sf_dir)
    return checks.unused_variables(all_declarations(nodes), sc.uses(nodes))


@query("pruned_declarations", f"""with {SCOPE} select pid, count(*) as n_nodes from nodes n
where tag not in ('DVarDecl', 'DVarDeclCls', 'DExceptionVar') or exists (select 1 from uses u where u.pid = n.pid and u.var_id = n.var_id) group by pid""")
def pruned_declarations(spark, sf_dir):
    """P14"""
    nodes = stored_nodes(spark, sf_dir)
    return sc.prune_unused(nodes, sc.uses(nodes)).groupBy("pid").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("object_init", f"""with {SCOPE}, o as (select distinct pid, var_id from nodes where tag = 'DVarDeclCls'),
i as (select pid, coalesce(ret_id, var_id) as var_id from nodes where tag in ('DClsInit', 'DAPIInvoke'))
select pid, var_id, exists (select 1 from i where i.pid = o.pid and i.var_id = o.var_id) as initialised from o
where exists (select 1 from i where i.pid = o.pid and i.var_id = o.var_id) or exists (select 1 from uses u where u.pid = o.pid and u.var_id = o.var_id)""")
def object_init(spark, sf_dir):
    """A13"""
    nodes = stored_nodes(spark, sf_dir)
    return checks.object_initialisation(nodes, sc.uses(nodes))


@query("learned_compat", f"with {SCOPE} select role, declared, usage from compat")
def learned_compat(spark, sf_dir):
    """A7, learned from all programs."""
    return checks.learn_compat(uses_of_programs(spark, sf_dir))


@query("compat_violations", f"with {SCOPE} select pid, node_id, use_no, role, var_id from violations")
def compat_violations(spark, sf_dir):
    """Uses as no other program has them."""
    used = persist_table(uses_of_programs(spark, sf_dir), "uses")
    return checks.seen_nowhere_else(used).select("pid", "node_id", "use_no", "role", "var_id")


FLAGS = SCOPE + """,
base as (select pid, count(*) as statements, not bool_or(tag = 'DAPIInvoke') as void, not bool_or(tag = 'DReturnVar') and pid % 3 <> 0 as no_return from nodes group by pid),
miss as (select pid, bool_or(role <> 'ret') as undeclared, bool_or(role = 'ret') as "null" from resolved
  where not found and var_id not in ('system_package', 'LITERAL', 'no_return_var') group by pid),
flags as (select base.*, coalesce(undeclared, false) as undeclared, coalesce("null", false) as "null", pid in (select pid from violations) as type,
  pid in (select d.pid from decls d where not exists (select 1 from uses u where u.pid = d.pid and u.var_id = d.var_id)) as unused from base left join miss using (pid)),
outcomes as (select pid, statements, case """ + " ".join(
    f"when \"{flag}\" then 'This program failed because it {text}'" for flag, text in checks.OUTCOMES
) + " else 'This program passed' end as outcome from flags)"


def program_flags(spark, sf_dir):
    nodes, n = dealt_nodes(spark, sf_dir)
    declared = all_declarations(nodes)
    used = persist_buckets(sc.resolve_uses(nodes, GIVEN), "uses", "pid", n)
    kind = F.when(F.col("pid") % 3 == 0, "void").otherwise("int")
    types = nodes.select("pid").distinct().withColumn("return_type", kind)
    return checks.program_flags(nodes, used, checks.seen_nowhere_else(used), types, declared)


@query("static_outcome", f"with {FLAGS} select pid, statements, outcome from outcomes")
def static_outcome(spark, sf_dir):
    """X23, F40, A14"""
    return program_flags(spark, sf_dir).select("pid", "statements", checks.outcome().alias("outcome"))


@query("outcome_counts", f"with {FLAGS} select outcome, count(*) as programs from outcomes group by outcome")
def outcome_counts(spark, sf_dir):
    """A8"""
    return checks.outcome_counts(program_flags(spark, sf_dir))


@query("failure_histogram", f"""with {FLAGS}, l as ({" union all ".join(f"select '{f}' as kind, statements as length from flags where " + chr(34) + f + chr(34) for f, _ in checks.OUTCOMES)}),
c as (select kind, length, count(*) as n from l group by all)
select kind, length, n, round(n * 100.0::double / sum(n) over (partition by kind), 6) as pct from c""")
def failure_histogram(spark, sf_dir):
    """A10"""
    out = checks.failure_histogram(program_flags(spark, sf_dir))
    return out.select("kind", "length", "n", F.round("pct", 6).alias("pct"))


@query("rates_with_blanks", f"""with {SCOPE}, m as (select t.role, t.exempt, (v.pid is not null) or (not t.found and not t.exempt) as failed
  from typed t left join violations v on v.pid = t.pid and v.node_id = t.node_id and v.use_no = t.use_no),
c as (select role, count(*) filter (not failed) as passed, count(*) filter (not failed and exempt) as blank, count(*) filter (failed) as failed from m group by role)
select role, passed, blank, failed, round(passed / (passed + failed + 0.001::double) * 100, 6) as pct, round(blank / (passed + failed + 0.001::double) * 100, 6) as pct_blank,
  round((passed - blank) / (passed - blank + failed + 0.001::double) * 100, 6) as pct_effective from c""")
def rates_with_blanks(spark, sf_dir):
    """A9"""
    used = persist_table(uses_of_programs(spark, sf_dir), "uses")
    wrong = checks.seen_nowhere_else(used)
    out = checks.use_rates(used, wrong)
    return out.select("role", "passed", "blank", "failed", *[F.round(c, 6).alias(c) for c in ("pct", "pct_blank", "pct_effective")])


@query("rename_variables", f"""with {TREE}, f as (select pid, var_id, min(node_id) as node0 from nodes where tag in ('DVarDecl', 'DVarDeclCls', 'DExceptionVar') group by all),
k as (select pid, var_id, row_number() over (partition by pid order by node0, var_id) - 1 as k from f),
perm as (select pid, i, row_number() over (partition by pid order by md5('12:' || pid || ':' || i)) - 1 as place from (select distinct pid from k), (select unnest(range(0, 10)) as i))
select k.pid, var_id, k::int as k, 'var_' || coalesce(i, k) as mapped from k left join perm on perm.pid = k.pid and place = k""")
def rename_variables(spark, sf_dir):
    """J13"""
    nodes = pj.program_nodes(spark, sf_dir, only=("pid", "node_id", "var_id", "scope", "tag", "returns"))
    return sc.rename_variables(sc.declarations(nodes))


# Lower caps than the default, as orders are small.
LABEL_LIMITS = Options(max_nodes=14, max_branches=2, max_loops=1, max_tries=1, max_variables=7)

LABELS = SCOPE + """,
pre as (select pid, sum((flag = 'R')::int) over w + (flag = 'A' and status = 'F')::int as b, sum((flag = 'A')::int) over w as l, sum((flag = 'N' and status = 'F')::int) over w as e
  from lines window w as (partition by pid order by ln rows unbounded preceding)),
deep as (select pid, max(b) as b, max(l) as l, max(e) as e from pre group by pid),
sizes as (select pid, count(*) as n, count(*) filter (tag in ('DVarDecl', 'DVarDeclCls', 'DExceptionVar')) as decls, count(*) filter (tag = 'DAPIInvoke') as calls,
  bool_or(tag = 'DReturnVar') as returned, bool_or(tag = 'DReturnVar' and (returns is null or returns <> case when pid % 3 = 0 then 'void' else 'int' end)) as off,
  max(greatest(try_cast(regexp_extract(var_id, '^var_([0-9]+)', 1) as int), try_cast(regexp_extract(expr_id, '^var_([0-9]+)', 1) as int),
    try_cast(regexp_extract(ret_id, '^var_([0-9]+)', 1) as int), try_cast(regexp_extract(arg, '^var_([0-9]+)', 1) as int))) as highest from nodes group by pid),
unknown as (select distinct pid from resolved where not found and var_id not in ('system_package', 'LITERAL', 'no_return_var')),
wrong as (select distinct pid from violations),
faults as (select o_orderkey as pid, coalesce(n, 0) as statements, false as assignment, false as nested_api, u.pid is not null as unknown_variable,
  coalesce(decls, 0) >= 7 or coalesce(highest, -1) >= 7 as too_many_variables, coalesce(n, 0) > 14 as too_large, coalesce(b, 0) > 2 as branch, coalesce(l, 0) > 1 as loop, coalesce(e, 0) > 1 as try,
  coalesce(calls, 0) = 0 as void, x.pid is not null or coalesce(off, false) as type, o_orderkey % 3 <> 0 and not coalesce(returned, false) as no_return
  from orders left join sizes s on s.pid = o_orderkey left join deep d on d.pid = o_orderkey left join unknown u on u.pid = o_orderkey left join wrong x on x.pid = o_orderkey),
labels as (select *, case """ + " ".join(f"when \"{r}\" then '{r}'" for r in labels.REASONS) + " end as reason from faults)"


def label_programs(spark, sf_dir):
    nodes, n = dealt_nodes(spark, sf_dir, "parent_tag", "seq_in", "seq_out", "list_end")
    used = persist_buckets(sc.resolve_uses(nodes, GIVEN), "uses", "pid", n)
    kind = F.when(F.col("pid") % 3 == 0, "void").otherwise("int")
    programs = pj.methods(spark, sf_dir).select("pid", kind.alias("return_type"), F.lit(len(PARAMETERS)).alias("params"))
    return labels.label(nodes, programs, used, checks.seen_nowhere_else(used), LABEL_LIMITS)


@query("program_labels", f"with {LABELS} select pid, statements, {', '.join(chr(34) + r + chr(34) for r in labels.REASONS)}, reason from labels")
def program_labels(spark, sf_dir):
    """Every fault of every program, from its tree; none is filtered."""
    return label_programs(spark, sf_dir)


@query("label_counts", f"""with {LABELS} {" union all ".join(f"select '{r}' as reason, count(*) filter ({chr(34)}{r}{chr(34)}) as programs, count(*) filter (reason = '{r}') as first from labels" for r in labels.REASONS)}
union all select 'passed', count(*) filter (reason is null), count(*) filter (reason is null) from labels""")
def label_counts(spark, sf_dir):
    """A3: all eleven reasons, with those that nothing fell to."""
    return labels.label_counts(label_programs(spark, sf_dir))


# --- over events and lines -----------------------------------------------------------------

CTX = "'/' || (hour(ts) // 2) || case when hour(ts) % 2 = 0 then '.cond' else '.body' end"


@query("hasnext_guard", f"""with c as (select user_id as pid, {CTX} as ctx, ts, event_type from events),
f as (select pid, ctx, min(ts) as first_at from c where event_type = 'view' group by all)
select c.pid, c.ts, c.ctx, coalesce(f.first_at <= c.ts, false) or coalesce(g.first_at <= c.ts, false) as guarded from c
left join f on f.pid = c.pid and f.ctx = c.ctx left join f g on g.pid = c.pid and g.ctx = regexp_replace(c.ctx, '\\.(then|else|body)$', '.cond') where event_type = 'click'""")
def hasnext_guard(spark, sf_dir):
    """J9"""
    hour = F.hour("ts")
    ctx = F.concat(F.lit("/"), F.floor(hour / 2).cast("string"), F.when(hour % 2 == 0, ".cond").otherwise(".body"))
    which = F.when(F.col("event_type") == "view", "hasNext").when(F.col("event_type") == "click", "next")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), ctx.alias("ctx"), F.col("ts").alias("at"), which.alias("which"))
    return checks.iterator_guard(calls).select("pid", F.col("at").alias("ts"), "ctx", "guarded")


@query("internal_exists", f"""with {SIBLINGS} select l_linenumber, count(*) filter (s.pid is not null) as passed, count(*) filter (s.pid is null) as failed
from lineitem left join siblings s on s.pid = l_orderkey and s.id = l_linenumber + 2 group by l_linenumber""")
def internal_exists(spark, sf_dir):
    """J10"""
    known = siblings.sample_siblings(pj.methods(spark, sf_dir)).select("pid", "id", F.lit(True).alias("ok"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), "l_linenumber", (F.col("l_linenumber") + 2).alias("id"))
    return lines.join(known, ["pid", "id"], "left").groupBy("l_linenumber").agg(
        F.count_if("ok").alias("passed"), F.count_if(F.col("ok").isNull()).alias("failed")
    )


@query("prefix_lookup", f"""with {PARTS}, t as (select distinct 'java.' || split_part(api, '.', 2) || '.' || replace(p_brand, '#', '') as type from apis)
select type, arg_min(api, p_partkey) as api from t join apis on starts_with(api, type) group by type""")
def prefix_lookup(spark, sf_dir):
    """J7"""
    apis = pj.apis(spark, sf_dir)
    types = apis.select(F.concat(F.lit("java."), F.split_part("api", F.lit("."), F.lit(2)), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("type"))
    return checks.constructors_for(types, apis.select("api", F.col("p_partkey").alias("id")))


ALLOW = (("package", "java.sql"), ("package", "java.net"), ("class", "java.swing.Brand7"), ("class", "java.awt.Brand12"), ("module", "javax"))


@query("api_allowed", f"""with {CALLS}, q as (select *, regexp_replace(regexp_replace(split_part(regexp_replace(api, '^\\$.*\\$', ''), '(', 1), '<.*>', ''), '\\.[^.]*$', '') as owner from calls)
select pid, count(*) as n_calls from q where regexp_replace(owner, '\\.[^.]*$', '') in ('java.sql', 'java.net') or owner in ('java.swing.Brand7', 'java.awt.Brand12') or split_part(owner, '.', 1) = 'javax' group by pid""")
def api_allowed(spark, sf_dir):
    """P4, S21"""
    allow = spark.createDataFrame(list(ALLOW), "level string, name string")
    return checks.allowed_calls(pj.calls(spark, sf_dir), allow).groupBy("pid").agg(F.count(F.lit(1)).alias("n_calls"))


RULES = """f as (select l_orderkey as pid, count(*) as nodes, count(*) filter (l_returnflag = 'A') as loops, count(*) filter (l_returnflag = 'R') as branches,
  count(*) filter (l_returnflag = 'N' and l_linestatus = 'F') as tries, max(l_suppkey % 13) as top_var, count(*) filter (l_linestatus = 'O') as apis from lineitem group by 1),
r as (select o_orderkey as pid, case when f.pid is null then 'void' when loops > 2 then 'loops' when branches > 2 then 'branches' when tries > 2 then 'tries' when nodes > 8 then 'too_large'
  when apis = 0 then 'void' when top_var >= 12 then 'variables' when o_totalprice > 400000 then 'type' end as reject_reason from orders left join f on f.pid = o_orderkey)"""


def reject_table(spark, sf_dir):
    line = F.col("l_returnflag")
    features = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pid")).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(line == "A").alias("loops"), F.count_if(line == "R").alias("branches"),
        F.count_if((line == "N") & (F.col("l_linestatus") == "F")).alias("tries"), F.max(F.col("l_suppkey") % 13).alias("top_var"),
        F.count_if(F.col("l_linestatus") == "O").alias("apis"),
    )
    orders = pj.methods(spark, sf_dir).join(features, "pid", "left")
    reason = checks.reject_reason([
        ("void", F.col("nodes").isNull()), ("loops", F.col("loops") > 2), ("branches", F.col("branches") > 2), ("tries", F.col("tries") > 2),
        ("too_large", F.col("nodes") > 8), ("void", F.col("apis") == 0), ("variables", F.col("top_var") >= 12), ("type", F.col("total") > 400000),
    ])
    return orders, reason


@query("reject_reasons", f"with {RULES} select pid, reject_reason from r where reject_reason is not null")
def reject_reasons(spark, sf_dir):
    """P22, P12, P13"""
    orders, reason = reject_table(spark, sf_dir)
    return checks.split_rejects(orders, reason)[1].select("pid", "reject_reason")


@query("accepted", f"with {RULES} select pid from r where reject_reason is null")
def accepted(spark, sf_dir):
    """The programs that go on."""
    orders, reason = reject_table(spark, sf_dir)
    return checks.split_rejects(orders, reason)[0].select("pid")


@query("reject_counts", f"with {RULES} select coalesce(reject_reason, 'passed') as reason, count(*) as n from r group by 1")
def reject_counts(spark, sf_dir):
    """A3"""
    orders, reason = reject_table(spark, sf_dir)
    return orders.groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
