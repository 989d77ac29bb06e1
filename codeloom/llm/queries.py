"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import decontaminate as _decontaminate
from codeloom.llm import filter_audit as _filter_audit
from codeloom.llm import lexical_search as _lexical_search
from codeloom.llm import licences as _licences
from codeloom.llm import line_dedup as _line_dedup
from codeloom.llm import maxscore as _maxscore
from codeloom.llm import mixing as _mixing
from codeloom.llm import near_dups as _near_dups
from codeloom.llm import pii_crf as _pii_crf
from codeloom.llm import pseudo_likelihood as _pseudo_likelihood
from codeloom.llm import reply_trees as _reply_trees
from codeloom.llm import resampling as _resampling
from codeloom.llm import token_files as _token_files
from codeloom.llm.registry import MODULES, ORACLES, QUERIES, query
from codeloom.session import persist_table, table

__all__ = ["MODULES", "ORACLES", "QUERIES"]

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAMINATE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (select distinct item_id, len, array_to_string(list_slice(w, at_, at_ + len - 1), ' ') as g
       from (select item_id, w, least(len(w), 10) as len, unnest(range(1, len(w) - least(len(w), 10) + 2)) as at_ from b where len(w) > 0)),
lens as (select distinct len from bw),
dw as (select r, at_, len, array_to_string(list_slice(w, at_, at_ + len - 1), ' ') as g
       from (select r, w, len, unnest(range(1, greatest(len(w) - len + 2, 1))) as at_ from d, lens)),
hit as (select r, at_, dw.len, item_id from dw join bw on dw.len = bw.len and dw.g = bw.g),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(at_, at_ + len)) as p from hit) group by r),
it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join it using (r)
"""


@query("op7_decontaminate", _DECONTAMINATE_SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    scanned = _decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_MIX_SQL = r"""
with d as (select doc_id, coalesce('s' || source, 't') as src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  length(text) - length(translate(text, '!#$%&*|', '')) as symbols from documents),
k as (select doc_id, src, size, -ln((cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '~')), 1, 12) as bigint) + 0.5::double) / 281474976710656.0::double)
             / ((size + 1.0::double) / (size + 1.0::double + coalesce(symbols, 0))) as key from d),
s as (select src, cast(sum(size) as bigint) as source_size, ([3, 1, 2])[(row_number() over (order by src) - 1) % 3 + 1]::double as w from d group by src),
c as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, src rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (order by 2.0::double * source_size / w, src rows between current row and unbounded following) as level from s),
t as (select src, source_size, least(2.0::double * source_size, max(level) over () * w) as target from c),
a as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as epochs from t),
p as (select k.*, a.*, sum(size) over (partition by k.src order by key, doc_id, size rows unbounded preceding) - size as before from k join a on k.src = a.src),
q as (select *, least(epochs + (2 * before + size <= 2 * (target - epochs * source_size))::int, 2) as copies from p)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * copies as bigint) as taken, copies from q
"""


@query("op4_mix_sources", _MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return _mixing.mix(table(spark, sf_dir, "documents"))


_NEAR_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, at_, at_ + 4), ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as at_ from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from i join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
both_ as (select x, y from e union all select y, x from e),
reach as (select distinct x, x as y from both_ union select reach.x, both_.y from reach join both_ on reach.y = both_.x),
comp as (select x, min(y) as component_id from reach group by x)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from w left join n using (doc_id) left join comp on comp.x = doc_id
"""


@query("op8_minhash_forest", _NEAR_SQL)
def minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return _near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, read back."""
    folder, _ = _token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return _token_files.read(spark, folder, with_ids=False)


@query("op2_resample")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document and whether it is drawn."""
    return _resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


_SEARCH_SQL = """
with v as (select row_number() over () as r, vec_id as id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
e as (select r, unnest(range(len(v))) as k, unnest(v) as x from v),
m as (select q.r as qr, c.r as cr, sum(q.x * c.x)::bigint as score from e q join e c on q.k = c.k and q.r <> c.r join v on v.r = q.r where v.id % 100 = 0 group by q.r, c.r),
s as (select q.r, q.id as query_id, c.id as vec_id, coalesce(score, 0) as score from v q join v c on q.r <> c.r left join m on qr = q.r and cr = c.r where q.id % 100 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""


@query("op6_maxscore", _SEARCH_SQL)
def maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best partners of every hundredth vector."""
    return _maxscore.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op10_pii_crf")
def pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return _pii_crf.find(table(spark, sf_dir, "documents")).drop("found")


_LINES_SQL = rf"""
with l as (select doc_id, line_no - 1 as line_no, lines[line_no] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as line_no
           from (select doc_id, string_split({_LOWER}, chr(10)) as lines from documents))),
t as (select distinct doc_id, line_no, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from l),
f as (select line, min(doc_id * 100000 + line_no) as place from l group by line),
ft as (select distinct place, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from f),
n as (select place, count(*) as n from ft group by place),
i as (select a.place as x, b.place as y, count(*) as c from ft a join ft b on a.w = b.w and a.place < b.place
      join n na on na.place = a.place join n nb on nb.place = b.place where 5 * least(na.n, nb.n) >= 4 * greatest(na.n, nb.n) group by a.place, b.place),
gone as (select distinct y as place from i join n nx on nx.place = x join n ny on ny.place = y where 9 * c >= 4 * (nx.n + ny.n)),
r as (select doc_id, line_no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0 and (l.doc_id * 100000 + l.line_no > f.place or f.place in (select place from gone)) as repeat
      from l join f using (line))
select doc_id, count(*) as n_lines, count(*) filter (where repeat) as n_removed,
       md5(coalesce(string_agg(cast(line_no as varchar), ',' order by line_no) filter (where repeat), '')) as removed_md5
from r group by doc_id
"""


@query("op1_line_dedup", _LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line."""
    found = _line_dedup.find_repeats(table(spark, sf_dir, "documents"))
    places = F.array_sort(F.collect_list(F.when(F.col("repeat"), F.col("line_no"))))
    return found.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("repeat").cast("long")).alias("n_removed"), F.md5(F.array_join(places.cast("array<string>"), ",")).alias("removed_md5"),
    )


@query("op3_pseudo_likelihood")
def pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return _pseudo_likelihood.score(table(spark, sf_dir, "documents"))


@query("op5_licences")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return _licences.scan(table(spark, sf_dir, "documents")).drop("notices")


_AUDIT_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
f as (select r, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        concat(case when len(w) < 50 then 'A' else '' end, case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end,
               case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 'C' else '' end, case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
               case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as fails
      from d left join l on d.doc_id = l.doc_id),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || e.x || g.x as filter_order from x a, x b, x c, x e, x g where a.x <> b.x and a.x <> c.x and a.x <> e.x and a.x <> g.x and b.x <> c.x and b.x <> e.x and b.x <> g.x and c.x <> e.x and c.x <> g.x and e.x <> g.x),
s as (select filter_order, step, filter_order[step] as letter from o, (select unnest(range(1, 6))::int as step)),
h as (select f.*, filter_order, step, letter, least(case when contains(fails, filter_order[1]) then 1 else 9 end, case when contains(fails, filter_order[2]) then 2 else 9 end,
        case when contains(fails, filter_order[3]) then 3 else 9 end, case when contains(fails, filter_order[4]) then 4 else 9 end, case when contains(fails, filter_order[5]) then 5 else 9 end) as gone from f, s),
c as (select part, filter_order, step, letter, count(*) filter (gone > step) as kept, count(*) filter (gone = step) as removed, count(*) filter (gone < step and contains(fails, letter)) as redundant,
        count(*) filter (fails = letter) as unique_fails, count(*) filter (gone = step and good) as good_lost, count(*) filter (gone = step and toxic) as toxic_lost from h group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from c
"""


@query("op13_filter_audit", _AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, order of the five filters, and step."""
    return _filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts hold the template's own marks.
CONTROL_TEXT = "\\### Assistant: </turn> ok"
_CHAT_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'),
e as (select *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') as body,
             replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') as head from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""


@query("op12_reply_trees", _CHAT_SQL)
def reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted, written and read back."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = _reply_trees.chain(said.unionByName(marks), "conv_id", "turn")
    written = persist_table(_reply_trees.conversations(_reply_trees.paths(messages)), "conversations")
    return _reply_trees.read_back(written).withColumnRenamed("tree", "conv_id")


_RANKED_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark where item_id is not null),
n as (select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0),
p as (select r, doc_id, len(w)::bigint as n, t, count(*)::bigint as tf from (select r, doc_id, w, unnest(w) as t from d) group by all),
f as (select t, floor(1000 * ln((2 * n.n + 2)::double / (2 * count(*) + 1)::double))::bigint as wt from p, n group by t, n.n),
s as (select item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * n.n) // n.l))))::bigint as score from q join p using (t) join f using (t), n group by all),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""


@query("op11_lexical_search", _RANKED_SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return _lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
