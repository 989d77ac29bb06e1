"""Syntax-tree queries over programs built from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import trees as tr
from codeloom.plans import projection as pj
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import CALLS, LINE_ORDER, TREE
from codeloom.session import persist_buckets, persist_table


def nodes(spark, sf_dir, *only):
    """The node table of all programs, with ``only`` the columns that a query reads."""
    return pj.program_nodes(spark, sf_dir, only=only or None)


@query("tree_flatten", f"""with {TREE}
select pid, node_id, parent_id, slot, slot_pos, depth, scope, tag, var_id, expr_id, ret_id, returns, call, arg from nodes""")
def tree_flatten(spark, sf_dir):
    """X1"""
    first = F.get("calls", F.lit(0))
    return nodes(spark, sf_dir, "pid", "node_id", "parent_id", "slot", "slot_pos", "depth", "scope", "tag", "calls", "var_id", "expr_id", "ret_id", "returns").select(
        "pid", "node_id", "parent_id", "slot", "slot_pos", "depth", "scope", "tag", "var_id", "expr_id", "ret_id", "returns",
        first["call"].alias("call"), F.when(F.size(first["args"]) > 0, F.get(first["args"], F.lit(0))).alias("arg"),
    )


_SETS = "(flag = 'N' or (flag = 'R' and status = 'O'))"
_LAST = "last_value(case when {sets} and op in ({ops}) then op end ignore nulls) over (partition by pid order by ln rows between unbounded preceding and 1 preceding)"


@query("iterator_attributes", f"""with {TREE},
o as (select *, case l_suppkey % 5 when 0 then 'h' when 1 then 'n' when 2 then 'r' end as op from lines),
e as (select pid, ln, op, coalesce({_LAST.format(sets=_SETS, ops="'h'")}, '') = 'h' as b0, coalesce({_LAST.format(sets=_SETS, ops="'h', 'n'")}, '') = 'n' as b1,
  coalesce({_LAST.format(sets=_SETS, ops="'h', 'r'")}, '') = 'r' as b2 from o),
f as (select n.pid, node_id, b0, b1, b2, case when (l.flag = 'R' and l.status = 'O' and n.k >= 2) or (l.flag = 'A' and l.status = 'O' and n.k = 2) then op end as done
  from nodes n join e on e.pid = n.pid and e.ln = n.ln join lines l on l.pid = n.pid and l.ln = n.ln)
select pid, node_id, (b0 or coalesce(done, '') = 'h')::int as has_next, ((b1 and coalesce(done, '') <> 'h') or coalesce(done, '') = 'n')::int as next,
  ((b2 and coalesce(done, '') <> 'h') or coalesce(done, '') = 'r')::int as removed from f""")
def iterator_attributes(spark, sf_dir):
    """Iterator flags that each node inherits."""
    rows = pj.iterator_program_nodes(spark, sf_dir, only=("pid", "node_id", "iattrib"))
    return rows.select("pid", "node_id", *[F.get("iattrib", F.lit(i)).alias(name) for i, name in enumerate(("has_next", "next", "removed"))])


@query("tree_roundtrip", f"""with {TREE} select pid, count(*) as n_nodes, true as same from nodes group by pid""")
def tree_roundtrip(spark, sf_dir):
    """Node rows to JSON and back give the same rows."""
    read = ("pid", "node_id", "parent_id", "slot", "slot_pos", "scope", "tag", "calls", "var_id", "expr_id", "ret_id", "returns")
    rows = pj.stored_program_nodes(spark, sf_dir, read)[0]
    print_of = F.xxhash64("node_id", "parent_id", "slot", "slot_pos", "scope", "tag", "var_id", "expr_id", "ret_id", "returns", F.to_json("calls"))
    digest = lambda df, name: df.select("pid", print_of.alias("h")).groupBy("pid").agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.bit_xor("h").alias(f"h_{name}"))
    again = tr.flatten(tr.unflatten(rows), only=read)
    both = digest(rows, "a").join(digest(again, "b"), "pid", "left")
    same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b"))
    return both.select("pid", F.col("n_a").alias("n_nodes"), same.alias("same"))


@query("gather_calls", f"with {TREE} select pid, node_id, call, returns from nodes where tag = 'DAPIInvoke'")
def gather_calls(spark, sf_dir):
    """X2"""
    return tr.gather_calls(nodes(spark, sf_dir, "pid", "node_id", "scope", "tag", "calls")).select("pid", "node_id", "call", "returns")


@query("size_rule", f"with {TREE} select count(*) filter (n <= 30) as kept, count(*) filter (n > 30) as too_large from (select count(*) as n from nodes group by pid)")
def size_rule(spark, sf_dir):
    """P10 with a lower cap, as orders are small."""
    sizes = nodes(spark, sf_dir, "pid").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") <= 30).alias("kept"), F.count_if(F.col("n") > 30).alias("too_large"))


@query("nest_caps", f"""with {TREE},
pre as (select pid, ln, flag, status, sum((flag = 'R')::int) over w as b, sum((flag = 'A')::int) over w as l, sum((flag = 'N' and status = 'F')::int) over w as e
  from lines window w as (partition by pid order by ln rows unbounded preceding))
select pid, max(b + (flag = 'A' and status = 'F')::int)::int as path_branches, max(l)::int as path_loops, max(e)::int as path_tries,
  max((flag = 'R' or (flag = 'A' and status = 'F'))::int) as nested_branches, max((flag = 'A')::int) as nested_loops from pre group by pid""")
def nest_caps(spark, sf_dir):
    """Nesting as the rules count it, and plain nesting beside it."""
    return tr.nesting(pj.stored_program_nodes(spark, sf_dir, ("pid", "tag", "seq_in", "seq_out", "list_end"))[0]).select(
        "pid", F.col("path_DBranch").alias("path_branches"), F.col("path_DLoop").alias("path_loops"), F.col("path_DExcept").alias("path_tries"),
        F.col("nested_DBranch").alias("nested_branches"), F.col("nested_DLoop").alias("nested_loops"),
    )


@query("struct_counts", """select l_orderkey as pid,
  sum(case when l_returnflag = 'N' and l_linestatus = 'O' then 2 when l_returnflag = 'N' then 3 when l_returnflag = 'R' and l_linestatus = 'O' then 3
      when l_returnflag = 'R' then 1 when l_linestatus = 'O' then 2 else 1 end)::bigint as statements,
  count(*) filter (l_returnflag = 'A') as loops, count(*) filter (l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'F')) as branches,
  count(*) filter (l_returnflag = 'N' and l_linestatus = 'F') as excepts from lineitem group by l_orderkey""")
def struct_counts(spark, sf_dir):
    """A29"""
    return tr.structure_counts(nodes(spark, sf_dir, "pid", "scope", "tag"))


@query("programs_having", """select count(*) filter (b) as have_branch, count(*) filter (l) as have_loop, count(*) filter (t) as have_try, count(*) filter (not c) as void
from (select bool_or(l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus = 'F')) as b, bool_or(l_returnflag = 'A') as l,
  bool_or(l_returnflag = 'N' and l_linestatus = 'F') as t, bool_or(not (l_returnflag = 'N' and l_linestatus = 'F') and not (l_returnflag = 'R' and l_linestatus = 'F')) as c
  from lineitem group by l_orderkey)""")
def programs_having(spark, sf_dir):
    """A5, P11"""
    tag = F.col("tag")
    has = nodes(spark, sf_dir, "pid", "tag").groupBy("pid").agg(
        F.bool_or(tag == "DBranch").alias("b"), F.bool_or(tag == "DLoop").alias("l"), F.bool_or(tag == "DExcept").alias("t"),
        F.bool_or(tag == "DAPIInvoke").alias("c"),
    )
    return has.agg(
        F.count_if("b").alias("have_branch"), F.count_if("l").alias("have_loop"), F.count_if("t").alias("have_try"), F.count_if(~F.col("c")).alias("void")
    )


@query("tree_extra_infos", f"""with {TREE} select pid, case tag when 'DBranch' then 'conditional' when 'DLoop' then 'loop' else 'exception' end as keyword, count(*) as n
from nodes where tag in ('DBranch', 'DLoop', 'DExcept') group by all""")
def tree_extra_infos(spark, sf_dir):
    """A30 over trees."""
    return tr.extra_infos(nodes(spark, sf_dir, "pid", "node_id", "tag")).groupBy("pid", "keyword").agg(F.count(F.lit(1)).alias("n"))


def _paths_sql(calls_only: bool) -> str:
    inner = {
        ("N", "O"): (["{nm}"], []),
        ("N", "F"): (["DExcept"], [["DExcept", "DTry"], ["DExcept", "DTry", "DCatch"]]),
        ("R", "O"): (["DBranch"], [["DBranch", "DCond", "{nm}"], ["DBranch", "DCond", "DThen", "{nm}"], ["DBranch", "DCond", "DThen", "DElse"]]),
        ("R", "F"): (["DBranch"], [["DBranch", "DCond"], ["DBranch", "DCond", "DThen"], ["DBranch", "DCond", "DThen", "DElse"]]),
        ("A", "O"): (["DLoop"], [["DLoop", "DCond", "{nm}"], ["DLoop", "DCond", "DBody", "{nm}"]]),
        ("A", "F"): (["DLoop"], [["DLoop", "DCond"], ["DLoop", "DCond", "DBody", "DBranch"], ["DLoop", "DCond", "DBody", "DBranch", "DCond"],
                                 ["DLoop", "DCond", "DBody", "DBranch", "DCond", "DThen", "{nm}"], ["DLoop", "DCond", "DBody", "DBranch", "DCond", "DThen", "DElse"]]),
    }
    keep = (lambda p: [x for x in p if x == "{nm}"]) if calls_only else (lambda p: p)
    text = lambda p: " || '>' || ".join("nm" if x == "{nm}" else f"'{x}'" for x in keep(p)) or "''"
    root = " ".join(f"when flag = '{f}' and status = '{s}' then {text(r)}" for (f, s), (r, _) in inner.items())
    tails = " ".join(f"when flag = '{f}' and status = '{s}' then [{', '.join(text(p) for p in ps)}]" for (f, s), (_, ps) in inner.items() if ps)
    return f"""with {TREE},
labelled as (select pid, ln, flag, status, regexp_extract(split_part(api, '(', 1), '([^.]*)$', 1) as nm from lines),
pieces as (select pid, ln, case {root} end as root, case {tails} else []::varchar[] end as tails from labelled),
prefixed as (select pid, ln, tails, coalesce(string_agg(nullif(root, ''), '>' order by ln) over (partition by pid order by ln rows between unbounded preceding and 1 preceding), '') as before from pieces),
paths as (select pid, coalesce(string_agg(nullif(root, ''), '>' order by ln), '') as path from pieces group by pid
  union all select pid, concat_ws('>', nullif(before, ''), nullif(tail, '')) from (select pid, before, unnest(tails) as tail from prefixed))
select distinct pid, md5(path) as path_md5 from paths where path <> ''"""


PATHS = ("pid", "tag", "calls", "slot", "parent_id", "seq_in", "seq_out", "slot_ends", "list_end")


@query("tree_paths", _paths_sql(False))
def tree_paths(spark, sf_dir):
    """X4, X6, U4, U5"""
    return tr.root_leaf_paths(nodes(spark, sf_dir, *PATHS)).select("pid", F.md5("path").alias("path_md5"))


@query("call_paths", _paths_sql(True))
def call_paths(spark, sf_dir):
    """X5"""
    paths = tr.root_leaf_paths(nodes(spark, sf_dir, *PATHS), calls_only=True)
    return paths.select("pid", F.md5("path").alias("path_md5"))


@query("tree_productions", f"""with {TREE},
l as (select pid, node_id, parent_id, slot, slot_pos, case when tag = 'DAPIInvoke' then nm else tag end as rhs from nodes),
p as (select pid, node_id, parent_id, slot, rhs, lag(node_id) over (partition by pid, parent_id, slot order by slot_pos) as prev from l)
select p.rhs as rhs, case when prev is null then 'child' else 'sibling' end as edge,
  case when prev is not null then s.rhs when p.parent_id < 0 then 'DSubTree' else o.rhs || '>D' || upper(p.slot[2]) || p.slot[3:] end as lhs, count(*) as n
from p left join l s on s.pid = p.pid and s.node_id = p.prev left join l o on o.pid = p.pid and o.node_id = p.parent_id group by all""")
def tree_productions(spark, sf_dir):
    """Production rules of the corpus with their counts."""
    return tr.productions(nodes(spark, sf_dir, "pid", "node_id", "parent_id", "prev_id", "slot", "tag", "calls")).groupBy("lhs", "edge", "rhs").agg(F.count(F.lit(1)).alias("n"))


@query("tree_signatures", f"""with {TREE}, s as (select pid, md5(string_agg(depth || ':' || slot[2:] || ':' || tag, ' ' order by node_id)) as signature from nodes group by pid)
select signature, count(*) as programs from s group by signature""")
def tree_signatures(spark, sf_dir):
    """Programs of the same shape."""
    return tr.signatures(nodes(spark, sf_dir, "pid", "node_id", "depth", "slot", "tag")).groupBy("signature").agg(F.count(F.lit(1)).alias("programs"))


@query("remove_invalid", f"""with {TREE}, bad as (select pid, ln from lines where flag = 'A' and length(api) % 3 = 0)
select pid, count(*) as n_nodes from nodes n where not exists (select 1 from bad where bad.pid = n.pid and bad.ln = n.ln) group by pid""")
def remove_invalid(spark, sf_dir):
    """Loops with an invalid call lose their whole subtree."""
    rows = persist_table(nodes(spark, sf_dir, "pid", "node_id", "scope", "tag", "calls"), "nodes")  # read by four steps
    uses = tr.gather_calls(rows).where((F.length("call") % 3 == 0) & (F.col("scope") != ""))
    scoped = uses.select("pid", F.get(tr.entered_controls(F.col("scope")), F.lit(0))["control"].alias("node_id"))
    loops = rows.where(F.col("tag") == "DLoop").select("pid", "node_id")
    invalid = scoped.join(loops, ["pid", "node_id"], "left_semi")
    return tr.remove_invalid(rows, invalid).groupBy("pid").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("nonempty_controls", f"""with {TREE} select pid, node_id, tag from nodes n join lines l using (pid, ln) where l.flag <> 'R' or l.status <> 'F'""")
def nonempty_controls(spark, sf_dir):
    """Without return statements some branches hold nothing, and go as well."""
    rows = persist_table(nodes(spark, sf_dir, "pid", "node_id", "scope", "tag"), "nodes").where(F.col("tag") != "DReturnVar")
    return tr.drop_empty_controls(rows).select("pid", "node_id", "tag")


_MERKLE = f"""{TREE},
own as (select pid, node_id, parent_id, slot, slot_pos, depth, concat_ws(' ', tag, call) as label from nodes),
h2 as (select *, md5(label || '|') as hash, 1 as size from own where depth = 2),
c1 as (select pid, parent_id as id, string_agg(concat_ws(':', slot, slot_pos, hash), ',' order by slot, slot_pos) as inside, sum(size) as sizes from h2 group by all),
h1 as (select o.*, md5(label || '|' || coalesce(inside, '')) as hash, 1 + coalesce(sizes, 0) as size from own o left join c1 on c1.pid = o.pid and c1.id = o.node_id where depth = 1),
c0 as (select pid, parent_id as id, string_agg(concat_ws(':', slot, slot_pos, hash), ',' order by slot, slot_pos) as inside, sum(size) as sizes from h1 group by all),
h0 as (select o.*, md5(label || '|' || coalesce(inside, '')) as hash, 1 + coalesce(sizes, 0) as size from own o left join c0 on c0.pid = o.pid and c0.id = o.node_id where depth = 0),
h as (select pid, hash, size from h2 union all select pid, hash, size from h1 union all select pid, hash, size from h0)"""


def _hashes(spark, sf_dir):
    rows, n = pj.stored_program_nodes(spark, sf_dir, ("pid", "node_id", "parent_id", "slot", "slot_pos", "depth", "tag", "calls"))
    return tr.subtree_hashes(rows, F.concat_ws(" ", "tag", F.get("calls", F.lit(0))["call"])), n


@query("shared_subtrees", f"""with {_MERKLE} select hash, max(size)::bigint as size, count(*) as times, count(distinct pid) as programs from h group by hash having count(distinct pid) > 1""")
def shared_subtrees(spark, sf_dir):
    """Subtrees that several programs have, by Merkle hash."""
    return tr.shared_subtrees(_hashes(spark, sf_dir)[0])


@query("largest_shared_subtree", f"""with {_MERKLE}, s as (select hash from h group by hash having count(distinct pid) > 1)
select pid, max(size)::bigint as size, arg_max(hash, (size, hash)) as hash from h where hash in (select hash from s) group by pid""")
def largest_shared_subtree(spark, sf_dir):
    """The largest subtree that a program has in common with another."""
    hashes, n = _hashes(spark, sf_dir)
    hashes = persist_buckets(hashes, "hashes", "pid", n)  # read twice
    shared = tr.shared_subtrees(hashes).select("hash")
    best = F.max(F.struct("size", "hash"))
    return hashes.join(shared, "hash", "left_semi").groupBy("pid").agg(best["size"].alias("size"), best["hash"].alias("hash"))
