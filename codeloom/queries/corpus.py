"""Corpus preparation: duplicates, siblings, evidence, vocabularies, encoding, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.javatypes import balanced_brackets
from codeloom.operators import dedup, evidence, ranking, siblings, vocab
from codeloom.plans import projection as pj
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import CALLS, LINE_ORDER, METHODS, PARTS, camel, stop_word_list
from codeloom.session import persist_buckets, persist_table, table

WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda w: w <> '')"
TOKENS = f"""tokens as (select doc_id, lang, pos, token from (select doc_id, lang,
  unnest({WORDS.format('text')}) as token, generate_subscripts({WORDS.format('text')}, 1) as pos from documents))"""


def tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(tx.words(F.col("text"))).alias("pos", "token"))


def distinct_tokens(spark, sf_dir):
    """Each token once per document, in first-seen order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.array_distinct(tx.words(F.col("text")))).alias("pos", "token"))


# --- duplicates (U2) -------------------------------------------------------------------

@query("dedup_first", "select min(doc_id) as doc_id, md5(text) as text_md5 from documents group by text")
def dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = dedup.first_per_key(docs.select("doc_id", F.md5("text").alias("text_md5")), [F.col("text_md5")], "doc_id")
    return kept.select("doc_id", "text_md5")


@query("dedup_counts", """select count(*) as processed, count(distinct text) as passed,
  count(*) - count(distinct text) as not_unique from documents""")
def dedup_counts(spark, sf_dir):
    """A4: seen, passed and dropped records."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"))
    groups = dedup.copies_per_key(docs, [F.col("k")], "doc_id")
    return groups.agg(
        F.sum(F.col("dropped") + 1).alias("processed"), F.count(F.lit(1)).alias("passed"), F.sum("dropped").alias("not_unique")
    )


# --- siblings (J1, W1, W2) and internal calls (J2) --------------------------------------

SIBLINGS = METHODS + """,
ring as (select file, pid, method, row_number() over (partition by file order by md5('12:' || pid), pid) - 1 as ring,
  count(*) over (partition by file) as n from methods),
probes as (select file, pid, method, i, ((('0x' || substr(md5('13:' || pid), 1, 8))::bigint % n) + i) % n as ring
  from ring, (select unnest(range(0, 10)) as i) where i < n),
siblings as (select p.pid, r.pid as sibling_pid, r.method as sibling,
  row_number() over (partition by p.pid order by i) - 1 as id
  from probes p join ring r using (file, ring) where r.method <> p.method)"""


@query("sibling_sample", f"with {SIBLINGS} select pid, sibling_pid, sibling, id::int as id from siblings")
def sibling_sample(spark, sf_dir):
    return siblings.sample_siblings(pj.methods(spark, sf_dir))


@query("resolve_internal", f"""with {SIBLINGS},
internal as (select l_orderkey as pid, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o.method as callee
  from lineitem join ring t on l_orderkey = t.pid join ring o on o.file = t.file and o.ring = (t.ring + l_linenumber) % t.n)
select pid, callee, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sibling_pid, 'local_method_' || id as local_method
from internal join siblings using (pid) where callee = sibling""")
def resolve_internal(spark, sf_dir):
    methods = pj.methods(spark, sf_dir)
    placed = persist_table(siblings.ring(methods.select("file", "pid", "method")), "ring")  # met twice
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), *pj.LINE_ORDER)
    wanted = lines.join(placed, "pid").withColumn("ring", (F.col("ring") + F.col("l_linenumber")) % F.col("n"))
    callees = placed.select("file", "ring", F.col("method").alias("callee"))
    internal = wanted.select("pid", "file", "ring", *pj.LINE_ORDER).join(callees, ["file", "ring"])
    return siblings.resolve_internal(internal.select("pid", "callee", *pj.LINE_ORDER), siblings.sample_siblings(methods, listed=True))


# --- vocabularies (A2, A2b, J3, J4, W5, A32) -------------------------------------------

VOCAB = f"""{TOKENS},
vocab as (select token, row_number() over (order by first) as id from
  (select token, min((doc_id, pos)) as first from tokens {{where}} group by token))"""


@query("vocab_first_seen", f"with {VOCAB.format(where='')} select token, id from vocab")
def vocab_first_seen(spark, sf_dir):
    return vocab.build_vocab(distinct_tokens(spark, sf_dir), "doc_id", "pos")


@query("vocab_encode_oov", f"""with {VOCAB.format(where="where lang = 'en'")}
select doc_id, count(*) as n_tokens, count(*) filter (id is null) as n_unknown, sum(coalesce(id, 0))::bigint as id_sum
from tokens left join vocab using (token) where lang <> 'en' group by doc_id""")
def vocab_encode_oov(spark, sf_dir):
    """Text in other languages encoded with the English vocabulary; unknown tokens get 0."""
    all_tokens = tokens(spark, sf_dir)
    english = vocab.build_vocab(distinct_tokens(spark, sf_dir).where(F.col("lang") == "en"), "doc_id", "pos")
    counted = all_tokens.where(F.col("lang") != "en").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    coded = vocab.encode(counted, english)
    return coded.groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(F.col("id") == 0, F.col("n")).otherwise(0)).alias("n_unknown"),
        F.sum(F.col("id") * F.col("n")).alias("id_sum"),
    )


@query("vocab_decode", f"""with {TOKENS}
select doc_id, count(*) as n_tokens, md5(string_agg(token, ' ' order by pos)) as text_md5 from tokens
where token in (select token from tokens where lang = 'en') group by doc_id""")
def vocab_decode(spark, sf_dir):
    """Encode and decode give the in-vocabulary tokens back."""
    all_tokens = tokens(spark, sf_dir)
    english = vocab.build_vocab(distinct_tokens(spark, sf_dir).where(F.col("lang") == "en"), "doc_id", "pos")
    ids = vocab.encode(all_tokens.select("doc_id", "pos", "token"), english).select("doc_id", "pos", "id")
    back = vocab.decode(ids, english)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ")
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.md5(joined).alias("text_md5"))


ARG_TYPES = """(case p_size % 4 when 0 then []::varchar[] when 1 then ['int']
  when 2 then ['java.util.Map<java.lang.String,java.lang.Integer>', 'double'] else ['org.acme.Foo', 'Tau_T'] end)"""


@query("vocab_type_sources", f"""with {PARTS},
src as (select p_partkey, 0 as source, 0 as pos, replace(regexp_replace(split_part(api, '(', 1), '\\.[^.]*$', ''), '$NOT$', '') as token from apis
  union all select p_partkey, 0, 1, returns from apis
  union all select p_partkey, 0, generate_subscripts({ARG_TYPES}, 1) + 1, unnest({ARG_TYPES}) from apis
  union all select s_suppkey, 1, 0, n_name from supplier join nation on s_nationkey = n_nationkey),
v as (select token, min((source, p_partkey, pos)) as first from src group by token)
select token, row_number() over (order by first) as id,
  length(replace(token, '<', '')) = length(replace(token, '>', '')) as balanced from v""")
def vocab_type_sources(spark, sf_dir):
    """Each API token also adds its receiver, return and argument types; field types come after."""
    apis = pj.apis(spark, sf_dir).select(
        F.lit(0).alias("source"), F.col("p_partkey").alias("owner"),
        F.posexplode(vocab.api_side_tokens(F.col("api"), F.col("returns"))).alias("pos", "token"),
    )
    nation = table(spark, sf_dir, "nation")
    fields = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit(1).alias("source"), F.col("s_suppkey").alias("owner"), F.lit(0).alias("pos"), F.col("n_name").alias("token")
    )
    first = apis.unionByName(fields).groupBy("token").agg(F.min(F.struct("source", "owner", "pos")).alias("first"))
    numbered = ranking.positions(
        first, [F.col("first")], F.concat_ws(":", F.col("first.source"), F.lpad(F.floor(F.col("first.owner") / 1024).cast("string"), 20, "0")), out="id"
    )
    return numbered.select("token", (F.col("id") + 1).alias("id"), balanced_brackets(F.col("token")).alias("balanced"))


# --- evidence and encoding (A1, A30, F3–F5, F30, T13) ----------------------------------

TYPES_SQL = r"""list_distinct(list_concat(list_concat(
  list_transform(list_zip(regexp_extract_all({0}, 'java[x]?\.(\w*)\.(\w*)(\.([A-Z]\w*))*', 4), regexp_extract_all({0}, 'java[x]?\.(\w*)\.(\w*)(\.([A-Z]\w*))*', 2)),
    lambda z: case when coalesce(z[1], '') <> '' then z[1] else z[2] end),
  list_filter([""" + ", ".join(
    f"case when {{0}} = '{p}' or regexp_matches({{0}}, '\\W{p}') then '{b}' end" for p, b in
    {"byte": "Byte", "short": "Short", "int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean", "char": "Character"}.items()
) + r"""], lambda b: b is not null)), {1}))"""


def sql_types(expr: str, more: str = "[]::varchar[]") -> str:
    return TYPES_SQL.replace("{0}", expr).replace("{1}", more)


EVIDENCE = PARTS + rf""",
named as (select *, regexp_replace(api, '^\$.*\$', '') as plain from apis),
named2 as (select *, regexp_extract(regexp_replace(split_part(plain, '(', 1), '<.*>', ''), '([^.]*)$', 1) as raw_name,
  {sql_types('api', sql_types('returns'))} as types from named),
ev as (select p_partkey, case when regexp_matches(raw_name, '^[a-z]') then [raw_name] else []::varchar[] end as apicalls, types,
  list_filter(list_distinct(list_transform(flatten(list_transform(list_concat(list_concat(
     list_filter(string_split(regexp_replace(split_part(plain, '(', 1), '<.*>', ''), '.'), lambda p: p not in ('java', 'javax')), [raw_name]), types),
     lambda s: string_split({camel('s')}, '#'))), lambda s: lower(s))), lambda k: not list_contains({stop_word_list()}, k)) as keywords
  from named2)"""

EVIDENCE_LONG = EVIDENCE + """,
long as (select l_orderkey as pid, kind, token from (
  select l_orderkey, 'apicalls' as kind, unnest(apicalls) as token from lineitem join ev on l_partkey = p_partkey
  union all select l_orderkey, 'types', unnest(types) from lineitem join ev on l_partkey = p_partkey
  union all select l_orderkey, 'keywords', unnest(keywords) from lineitem join ev on l_partkey = p_partkey))"""


def evidence_places(spark, sf_dir):
    # A part file is small beside the arrays made from it: dealt by key before the text work, and met by a merge, not sent whole through the driver.
    apis = evidence.api_evidence(pj.apis(spark, sf_dir).repartition("p_partkey")).select("p_partkey", *evidence.KINDS)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), *pj.LINE_ORDER)
    n = pj.dealt_to(spark, sf_dir)
    met = lambda rows: rows.join(apis.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    if n:  # calls meet their arrays first and then their program, where places are found without another shuffle
        return evidence.first_places(pj.call_positions(met(lines), n)), n
    return evidence.first_places(met(pj.call_positions(lines))), n


@query("evidence_sets", f"with {EVIDENCE_LONG} select distinct pid, kind, token from long")
def evidence_sets(spark, sf_dir):
    return evidence_places(spark, sf_dir)[0].select("pid", "kind", "token")


@query("evidence_extra_infos", """select l_orderkey as pid,
  case when l_returnflag = 'R' then 'conditional' when l_returnflag = 'A' then 'loop' else 'exception' end as keyword, count(*) as n
from lineitem where l_returnflag <> 'N' or l_linestatus = 'F' group by all""")
def evidence_extra_infos(spark, sf_dir):
    """One keyword per control node, kept with its count (duplicates stay)."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").where((flag != "N") | (F.col("l_linestatus") == "F"))
    word = F.when(flag == "R", "conditional").when(flag == "A", "loop").otherwise("exception")
    return lines.groupBy(F.col("l_orderkey").alias("pid"), word.alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


ORACLE_ENCODED = (f"""with {EVIDENCE},
lines as (select l_orderkey as pid, row_number() over (partition by l_orderkey order by {LINE_ORDER}) as pos, ev.* from lineitem join ev on l_partkey = p_partkey),
-- elements of one call are ranked by their text, so the order does not hang on how a set is stored
long as (select pid, pos, 'apicalls' as kind, unnest(apicalls) as token from lines
  union all select pid, pos, 'types', unnest(types) from lines
  union all select pid, pos, 'keywords', unnest(keywords) from lines),
places as (select pid, kind, token, min(pos) as place from long group by all),
vocab as (select kind, token, row_number() over (partition by kind order by first, token) as id from
  (select kind, token, min((pid, place)) as first from places group by all)),
ranked as (select pid, kind, token, id, row_number() over (partition by pid, kind order by place, token) as rank from places join vocab using (kind, token)),
arrays as (select pid, kind, list(id order by rank) filter (rank <= 10) as ids from ranked group by all)
select pid, """ + ", ".join(
    f"array_to_string(coalesce(any_value(list_resize(ids, 10, 0)) filter (kind = '{k}'), list_resize([]::bigint[], 10, 0)), ',') as {k}"
    for k in evidence.KINDS) + " from arrays group by pid")


@query("encode_evidence", ORACLE_ENCODED)
def encode_evidence(spark, sf_dir):
    """Flagship: cap, gather evidence, number tokens first-seen, encode, cut and pad."""
    places, n = evidence_places(spark, sf_dir)
    places = persist_buckets(places, "places", "pid", n)  # read by the vocabulary and by the encoding
    numbered = persist_table(vocab.build_vocab(places, "pid", "place", keys=["kind"]), "vocabulary")  # small: its size is known before places meet it
    coded = evidence.encoded_sets(places, numbered, dealt=bool(n))
    return coded.select("pid", *[F.array_join(k, ",").alias(k) for k in evidence.KINDS])


# --- widths, batches, chunks (F30, T1–T4, T14, W3, W10, W11) ----------------------------

@query("pad_encode", f"""select doc_id, array_to_string(list_resize(list_transform({WORDS.format('text')}[1:10], lambda w: length(w)), 10, 0), ',') as word_lengths
from documents""")
def pad_encode(spark, sf_dir):
    lengths = F.transform(tx.words(F.col("text")), F.length)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.pad(lengths, 10), ",").alias("word_lengths"))


@query("batches", """with r as (select doc_id, row_number() over (order by md5('12:' || doc_id), doc_id) - 1 as pos, count(*) over () as n from documents)
select doc_id, pos, pos // 128 as batch_id from r where pos < (n // 128) * 128""")
def batches(spark, sf_dir):
    return ranking.whole_batches(table(spark, sf_dir, "documents").select("doc_id"), 128, 12, "doc_id").select("doc_id", "pos", "batch_id")


@query("batches_window", """with r as (select o_orderkey, row_number() over (order by md5('12:' || o_orderkey), o_orderkey) - 1 as pos, count(*) over () as n from orders)
select o_orderkey, pos // 100 as batch_id from r where pos < least(n // 100, 10) * 100 and pos // 100 >= 2""")
def batches_window(spark, sf_dir):
    """Skip the first batches, stop after a cap."""
    rows = ranking.whole_batches(table(spark, sf_dir, "orders").select("o_orderkey"), 100, 12, "o_orderkey", max_batches=10)
    return rows.where(F.col("batch_id") >= 2).select("o_orderkey", "batch_id")


@query("chunks_ntile", "select o_orderkey, (ntile(32) over (order by o_orderkey) - 1)::int as chunk from orders")
def chunks_ntile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return ranking.equal_chunks(orders, 32, "o_orderkey", F.floor(F.col("o_orderkey") / 1024))


@query("max_rows", """select o_orderkey, pos from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos
from orders where o_orderstatus = 'F') where pos < 500""")
def max_rows(spark, sf_dir):
    """Stop after n accepted rows, in a fixed order."""
    ok = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    ranked = ranking.positions(ok, [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 1024))
    return ranked.where(F.col("pos") < 500)


@query("slot_packing", f"""with c as (select l_orderkey as pid, {LINE_ORDER},
  row_number() over (partition by l_orderkey order by {LINE_ORDER}) as rank from lineitem where l_returnflag = 'N')
select pid, array_to_string(list_resize(list(l_suppkey order by rank) filter (rank <= 10), 10, 0), ',') as slots from c group by pid""")
def slot_packing(spark, sf_dir):
    """Chosen elements move to the left of a zero array."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pid").where(F.col("l_returnflag") == "N")
    salt = F.pmod(F.xxhash64(*pj.LINE_ORDER), F.lit(64))
    chosen = ranking.top_k(lines.select("pid", *pj.LINE_ORDER), ["pid"], pj.line_order(), 10, salt)
    packed = F.transform(F.array_sort(F.collect_list(F.struct(*pj.LINE_ORDER))), lambda s: s["l_suppkey"])
    return chosen.groupBy("pid").agg(F.array_join(tx.pad(packed, 10, F.lit(0).cast("bigint")), ",").alias("slots"))
