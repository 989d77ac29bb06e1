"""Text, type and API-string functions over documents, conversations, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import javatypes as jt, text as tx
from codeloom.operators import siblings
from codeloom.plans import projection as pj
from codeloom.operators.evidence import api_evidence
from codeloom.queries.corpus import EVIDENCE, SIBLINGS
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import CALLS, METHODS, PARTS, camel, stop_word_list
from codeloom.session import table

LETTERS = r"regexp_replace(regexp_replace(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'), '[0-9]+', '', 'g'), '[^a-zA-Z]+', '#', 'g')"
NAME_WORDS = (
    "list_filter(list_transform(string_split(" + camel(LETTERS) + ", '#'), lambda w: lower(w)), "
    "lambda w: length(w) between 2 and 9 and not list_contains({stops}, w))"
)


def name_words_sql(expr: str) -> str:
    return NAME_WORDS.replace("{0}", expr).replace("{stops}", stop_word_list())


@query("camel_split", f"""select doc_id, len(string_split({camel('text')}, '#'))::int as parts, md5({camel('text')}) as marked_md5 from documents""")
def camel_split(spark, sf_dir):
    """F1"""
    docs = table(spark, sf_dir, "documents")
    parts = tx.split_camel(F.col("text"))
    return docs.select("doc_id", F.size(parts).alias("parts"), F.md5(F.array_join(parts, "#")).alias("marked_md5"))


@query("name_words", f"""select doc_id, len(w)::int as n_words, md5(array_to_string(w, ' ')) as words_md5
from (select doc_id, {name_words_sql('text')} as w from documents)""")
def name_words(spark, sf_dir):
    """F19, F2 on whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.name_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("method_names", f"""with {METHODS} select pid, array_to_string(list_resize({name_words_sql("split_part(method, '@', 1)")}, 3, ''), ',') as words from methods""")
def method_names(spark, sf_dir):
    """words of a method name, three wide."""
    words = tx.name_words(tx.method_base(F.col("method")))
    return pj.methods(spark, sf_dir).select("pid", F.array_join(tx.pad(words, 3, F.lit("")), ",").alias("words"))


@query("keywords_nostop", f"""select token, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) as token
from documents) where not list_contains({stop_word_list()}, token) group by token""")
def keywords_nostop(spark, sf_dir):
    """token counts without stop words."""
    docs = table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("token"))
    return docs.where(tx.not_stop_word(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("camel_names", """select p_partkey, split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) as name,
  trunc(p_retailprice * 100)::bigint / 100.0 as price from part""")
def camel_names(spark, sf_dir):
    """F21, F22"""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", tx.reconstruct_camel(F.split("p_name", " ")).alias("name"),
        tx.truncate_two_decimals(F.col("p_retailprice")).alias("price"),
    )


STRIP = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace({0}, chr(10), ''), '/\*\*(.*?)\*/', '', 'gs'), '\s+'), lambda w: w <> '' and not starts_with(w, '@')), ' ')"
HEADER = r"""(case when regexp_matches({0}, '\{.*\}', 's') then regexp_replace({0}, '\{.*\}', '', 'gs') else regexp_replace({0}, '\{.*', '', 'gs') end)"""


@query("strip_and_header", f"""with s as (select page_id, {STRIP.replace('{0}', 'html')} as plain from pages)
select page_id, md5(plain) as plain_md5, md5({HEADER.replace('{0}', 'plain')}) as header_md5, length({HEADER.replace('{0}', 'plain')})::int as header_len from s""")
def strip_and_header(spark, sf_dir):
    """F14, F15 on raw pages, whose scripts and styles have comments and braces."""
    pages = table(spark, sf_dir, "pages")
    head = tx.header(F.col("html"))
    return pages.select(
        "page_id", F.md5(tx.drop_doc_comments_and_annotations(F.col("html"))).alias("plain_md5"),
        F.md5(head).alias("header_md5"), F.length(head).alias("header_len"),
    )


SPACED = "replace(replace({0}, '.', ' . '), '=', ' = ')"
for _a, _b in (("= =", "=="), ("& &", "&&"), ("| |", "||"), ("< =", "<="), ("> =", ">=")):
    SPACED = f"replace({SPACED}, '{_a}', '{_b}')"
TOKENS_SQL = f"regexp_extract_all({SPACED}, '{tx.TOKEN}', 0)"


@query("code_tokens", f"""select page_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5
from (select page_id, {TOKENS_SQL.replace('{0}', 'html')} as t from pages)""")
def code_tokens(spark, sf_dir):
    """F17"""
    pages = table(spark, sf_dir, "pages").select("page_id", tx.code_tokens(F.col("html")).alias("t"))
    return pages.select("page_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("prune_comments", r"""select page_id, md5(regexp_replace(array_to_string(list_filter(regexp_split_to_array(html, '\r\n|\r|\n'), lambda l: not starts_with(l, '//')), chr(10)),
  '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) as code_md5,
  len(string_split(html, chr(10)))::int as n_lines, md5('// ' || array_to_string(string_split(html, chr(10)), chr(10) || '// ') || chr(10)) as block_md5 from pages""")
def prune_comments(spark, sf_dir):
    """F28, F34"""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(tx.prune_comments(html)).alias("code_md5"),
        F.size(F.split(html, "\n")).alias("n_lines"), F.md5(tx.comment_block(html)).alias("block_md5"),
    )


SUMMARY_SPACES = r"regexp_replace(regexp_replace(sentence, '<[^>]*>', '', 'g'), '[!-/:-@\[-`{-~\s]+', ' ', 'g')"
for _p in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
    SUMMARY_SPACES = f"regexp_replace({SUMMARY_SPACES}, '{_p}', '\\1 \\2', 'g')"


@query("doc_summary", rf"""with d as (select doc_id, case when regexp_matches(text, '^(.*?)\.\W.*$') and not contains(text, chr(10))
  then regexp_extract(text, '^(.*?)\.\W.*$', 1) else text end as sentence from documents)
select doc_id, case when regexp_matches(sentence, 'TODO|FIXME|NOTE|HACK|XXX') then null else md5(lower({SUMMARY_SPACES})) end as summary_md5 from d""")
def doc_summary(spark, sf_dir):
    """F33 on whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.doc_summary(F.col("text"))).alias("summary_md5"))


@query("context_string", f"""with {SIBLINGS},
heads as (select pid, string_agg(sibling, ' ' order by id) as headers from siblings group by pid)
select m.pid, concat_ws(' ', c_name, c_mktsegment, coalesce(headers, ''), ' ', method) as context
from methods m join customer on file = c_custkey left join heads h on h.pid = m.pid""")
def context_string(spark, sf_dir):
    """class, fields, sibling headers, documentation (missing here) and own header."""
    methods = pj.methods(spark, sf_dir)
    sampled = siblings.sample_siblings(methods)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("id", "sibling"))), lambda s: s["sibling"])
    heads = sampled.groupBy("pid").agg(F.array_join(in_order, " ").alias("headers"))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), "c_name", "c_mktsegment")
    joined = methods.join(owner, "file").join(heads, "pid", "left")
    context = tx.context_text(
        F.col("c_name"), F.col("c_mktsegment"), F.coalesce("headers", F.lit("")), F.lit(None).cast("string"), F.col("method")
    )
    return joined.select("pid", context.alias("context"))


# --- API and type strings --------------------------------------------------------------

ARGS_SQL = r"""(case p_size % 4 when 0 then '' when 1 then 'int' when 2 then 'java.util.Map<java.lang.String,java.lang.Integer>|double' else 'org.acme.Foo|Tau_T' end)"""
SIMPLE_ARGS = r"""(case p_size % 4 when 0 then '' when 1 then 'int' when 2 then 'java.lang.Object,double' else 'java.lang.Object,java.lang.Object' end)"""
OWNER = r"replace(regexp_replace(split_part(api, '(', 1), '\.[^.]*$', ''), '$NOT$', '')"


@query("api_parts", rf"""with {PARTS}
select p_partkey, regexp_extract(split_part(api, '(', 1), '([^.]*)$', 1) as api_name, {OWNER} as expr_type, {ARGS_SQL} as formal_types,
  returns as stored_returns, api as stored_api, true as round_trip from apis""")
def api_parts(spark, sf_dir):
    """F3, F11, F12, F13"""
    apis = pj.apis(spark, sf_dir)
    stored = jt.split_stored_call(jt.stored_call(F.col("api"), F.col("returns")))
    return apis.withColumn("s", stored).select(
        "p_partkey", jt.api_name(F.col("api")).alias("api_name"), jt.expr_type(F.col("api")).alias("expr_type"),
        F.array_join(jt.formal_types(F.col("api")), "|").alias("formal_types"),
        F.col("s.ret_type").alias("stored_returns"), F.col("s.api").alias("stored_api"),
        (F.col("s.expr_type") == jt.expr_type(F.col("api"))).alias("round_trip"),
    )


@query("simplify_strings", rf"""with {PARTS}
select p_partkey, replace(replace(split_part(api, '(', 1), '$NOT$', ''), '<java.util.List<Tau_E>,java.lang.String>', '<java.lang.Object,java.lang.String>')
  || '(' || {SIMPLE_ARGS} || ')' as api,
 case returns when 'java.util.List<Tau_E>' then 'java.util.List<java.lang.Object>' else returns end as returns,
 returns in ('void', 'int') as is_primitive from apis""")
def simplify_strings(spark, sf_dir):
    """F6, F7, F8, F9, F10, F23"""
    return pj.apis(spark, sf_dir).select(
        "p_partkey", jt.simplify_api(F.col("api")).alias("api"), jt.simplify_type(F.col("returns")).alias("returns"),
        jt.is_primitive(F.col("returns")).alias("is_primitive"),
    )


@query("types_and_keywords", f"""with {EVIDENCE} select p_partkey, array_to_string(list_sort(types), ',') as types, array_to_string(list_sort(keywords), ',') as keywords from ev""")
def types_and_keywords(spark, sf_dir):
    """F4, F5, U7"""
    return api_evidence(pj.apis(spark, sf_dir)).select(
        "p_partkey", F.array_join(F.array_sort("types"), ",").alias("types"), F.array_join(F.array_sort("keywords"), ",").alias("keywords")
    )


@query("call_display", rf"""with {PARTS}
select p_partkey, case when p_size % 2 = 0 then regexp_extract(split_part(api, '(', 1), '([^.]*)$', 1)
   else case when p_size % 5 = 0 then replace(p_brand, '#', '') || '<java.util.List<Tau_E>,java.lang.String>' else replace(p_brand, '#', '') end
     || '.' || regexp_extract(split_part(api, '(', 1), '([^.]*)$', 1) end as shown,
  '(' || (case p_size % 4 when 0 then '' when 1 then 'int: v1' when 2 then 'java.util.Map<java.lang.String,java.lang.Integer>: v1,double: LITERAL'
     else 'org.acme.Foo: v1,Tau_T: LITERAL' end) || ')' as arguments from apis""")
def call_display(spark, sf_dir):
    """F31, F32"""
    receiver = F.when(F.col("p_size") % 2 == 0, "var_0").otherwise("system_package")
    ids = F.array(F.lit("v1"), F.lit("LITERAL"))
    return pj.apis(spark, sf_dir).repartition("p_partkey").select(
        "p_partkey", jt.display_name(F.col("api"), receiver).alias("shown"), jt.typed_arguments(F.col("api"), ids).alias("arguments")
    )


@query("package_label", f"""with {CALLS}
select pid, case when count(distinct split_part(api, '.', 2)) = 1 then min(split_part(api, '.', 2)) else 'N/A' end as label from calls group by pid""")
def package_label(spark, sf_dir):
    """the one package all calls of a program share. Distinct packages per program, so no hot list."""
    packages = pj.calls(spark, sf_dir).select("pid", F.get(F.split("api", r"\."), F.lit(1)).alias("package"))
    known = packages.where(F.col("package").isin(*jt.PACKAGE_LABELS)).groupBy("pid").agg(
        F.min("package").alias("lo"), F.max("package").alias("hi")
    )
    programs = packages.select("pid").distinct()
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("N/A")
    return programs.join(known, "pid", "left").select("pid", F.coalesce(label, F.lit("N/A")).alias("label"))


@query("labelled_only", f"""with {CALLS}, l as (select pid, count(distinct split_part(api, '.', 2)) as k, min(split_part(api, '.', 2)) as label from calls group by pid)
select label, count(*) as programs from l where k = 1 group by label""")
def labelled_only(spark, sf_dir):
    """Unlabelled programs go; group sizes per label."""
    labels = package_label(spark, sf_dir).where(F.col("label") != "N/A")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("programs")).orderBy(F.desc("programs"), "label")


@query("iterator_flags", r"""select event_type, count(*) filter (event_type = 'view') as has_next, count(*) filter (event_type = 'click') as next,
  count(*) filter (event_type = 'error') as remove from events group by event_type""")
def iterator_flags(spark, sf_dir):
    """F24 over call texts drawn from events."""
    call = iterator_call(F.col("event_type"))
    return table(spark, sf_dir, "events").withColumn("call", call).groupBy("event_type").agg(
        *[F.count_if(jt.iterator_flag(F.col("call"), w)).alias(name) for w, name in
          (("hasNext", "has_next"), ("next", "next"), ("remove", "remove"))]
    )


def iterator_call(event_type):
    name = F.when(event_type == "view", "hasNext()").when(event_type == "click", "next()").when(event_type == "error", "remove()").otherwise("size()")
    return F.concat(F.lit("java.util.Iterator<java.lang.String>."), name)
