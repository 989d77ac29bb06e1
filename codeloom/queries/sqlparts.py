"""SQL for the program records that :mod:`codeloom.plans.projection` draws from the tables."""

PARTS = r"""apis as (select p_partkey, p_name, p_brand, p_type, p_size,
  (case when p_partkey % 7 = 0 then '$NOT$' else '' end) || 'java.'
  || (case p_type when 'MEDIUM' then 'swing' when 'STANDARD' then 'awt' when 'LARGE' then 'sql' when 'PROMO' then 'net'
      when 'SMALL' then 'xml' when 'ECONOMY' then 'math' end)
  || '.' || replace(p_brand, '#', '')
  || (case when p_size % 5 = 0 then '<java.util.List<Tau_E>,java.lang.String>' else '' end)
  || '.' || split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
  || '(' || (case p_size % 4 when 0 then '' when 1 then 'int' when 2 then 'java.util.Map<java.lang.String,java.lang.Integer>,double'
      else 'org.acme.Foo,Tau_T' end) || ')' as api,
  (case p_size % 3 when 0 then 'void' when 1 then 'java.util.List<Tau_E>' else 'int' end) as returns
  from part)"""

CALLS = PARTS + r""",
calls as (select l_orderkey as pid, l.* exclude (l_orderkey), api, returns from lineitem l join apis on l_partkey = p_partkey)"""

METHODS = r"""methods as (select o_orderkey as pid, o_custkey as file, o_orderpriority || '@' || o_orderkey as method,
  o_totalprice as total, o_orderstatus as status from orders)"""

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def stop_word_list() -> str:
    from codeloom.functions.words import STOP_WORDS

    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


CAMEL = r"regexp_replace(regexp_replace({0}, '(.)([A-Z][a-z]+)', '\1#\2', 'g'), '([a-z0-9])([A-Z])', '\1#\2', 'g')"


def camel(expr: str) -> str:
    return CAMEL.format(expr)

# The statements a line becomes: k-th node of the line, its parent k (-1: body), slot, place in the slot,
# depth, tag, declared or returned variable, receiver, target. v and w are variables, '' is none.
TREE = CALLS + f""",
tmpl(flag, status, k, pk, slot, sp, depth, tag, var, expr, ret, has_call, scope) as (values
 ('N','O',0,-1,'_nodes',0,0,'DVarDecl','v','','',0,''), ('N','O',1,-1,'_nodes',1,0,'DAPIInvoke','','s','v',1,''),
 ('N','F',0,-1,'_nodes',0,0,'DExcept','','','',0,''), ('N','F',1,0,'_try',0,1,'DVarDeclCls','v','','',0,'try'),
 ('N','F',2,0,'_try',1,1,'DClsInit','v','','',1,'try'), ('N','F',3,0,'_catch',0,1,'DExceptionVar','e','','',0,'catch'),
 ('R','O',0,-1,'_nodes',0,0,'DBranch','','','',0,''), ('R','O',1,0,'_cond',0,1,'DAPIInvoke','','v','n',1,'cond'),
 ('R','O',2,0,'_then',0,1,'DVarDecl','w','','',0,'then'), ('R','O',3,0,'_then',1,1,'DAPIInvoke','','s','w',1,'then'),
 ('R','F',0,-1,'_nodes',0,0,'DBranch','','','',0,''), ('R','F',1,0,'_else',0,1,'DReturnVar','v','','',0,'else'),
 ('A','O',0,-1,'_nodes',0,0,'DLoop','','','',0,''), ('A','O',1,0,'_cond',0,1,'DAPIInvoke','','v','n',1,'cond'),
 ('A','O',2,0,'_body',0,1,'DAPIInvoke','','w','n',1,'body'),
 ('A','F',0,-1,'_nodes',0,0,'DLoop','','','',0,''), ('A','F',1,0,'_body',0,1,'DBranch','','','',0,'body'),
 ('A','F',2,1,'_then',0,2,'DAPIInvoke','','v','n',1,'body/then')),
kinds as (select flag, status, count(*) as n_nodes, count(*) filter (pk < 0) as n_roots from tmpl group by all),
lines as (select *, row_number() over w as ln, (sum(n_nodes) over w - n_nodes)::int as base, (sum(n_roots) over w - n_roots)::int as root_base,
  'var_' || (l_suppkey % 7) as v, 'var_' || (l_partkey % 7) as w
  from calls join kinds on flag = l_returnflag and status = l_linestatus
  window w as (partition by pid order by {LINE_ORDER} rows unbounded preceding)),
nodes as (select pid, ln, k, base + k as node_id, case when pk < 0 then -1 else base + pk end as parent_id,
  slot, case when pk < 0 then root_base + sp else sp end as slot_pos, depth, tag,
  case var when 'v' then v when 'w' then w when 'e' then 'local_e' end as var_id,
  case expr when 'v' then v when 'w' then w when 's' then 'system_package' end as expr_id,
  case ret when 'v' then v when 'w' then w when 'n' then 'no_return_var' end as ret_id,
  case when has_call = 1 then api end as call, case when has_call = 1 and tag = 'DAPIInvoke' and not ends_with(api, '()') then w end as arg,
  case when tag in ('DBranch', 'DLoop', 'DExcept') then null else returns end as returns,
  case scope when '' then '' when 'body/then' then '/' || base || '.body/' || (base + 1) || '.then' else '/' || base || '.' || scope end as scope, v, w, base,
  case when has_call = 1 then regexp_extract(split_part(api, '(', 1), '([^.]*)$', 1) end as nm
  from lines join tmpl using (flag, status))"""
