"""Sources, sinks and streams: what is written is read back and returned."""

from __future__ import annotations

import hashlib
from datetime import timedelta

import pandas as pd
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import checks, ranking, vocab
from codeloom.plans import projection as pj
from codeloom.queries.checks import SCOPE, uses_of_programs
from codeloom.queries.corpus import ORACLE_ENCODED, TOKENS, VOCAB, distinct_tokens, encode_evidence
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import METHODS
from codeloom.queries.textual import TOKENS_SQL
from codeloom.session import new_folder, persist_table, table
from codeloom.sources import aligned, epochs, programs as src, stores
from codeloom.sources.growing import GrowingStore
from codeloom.streaming import ingest, late


@query("json_chunks", f"with {METHODS} select (ntile(32) over (order by pid) - 1)::int as chunk, pid, file, method from methods")
def json_chunks(spark, sf_dir):
    """Chunked JSON, gathered again."""
    path = new_folder(spark, "chunks")
    chunked = ranking.equal_chunks(pj.methods(spark, sf_dir), 32, "pid", F.floor(F.col("pid") / 1024))
    src.write_chunks(chunked.select("pid", "file", "method", "chunk"), path)
    return src.gather_chunks(spark, path, "pid bigint, file bigint, method string")


@query("corpus_size", "select chunk, count(*) as size from (select (ntile(32) over (order by o_orderkey) - 1)::int as chunk from orders) group by chunk")
def corpus_size(spark, sf_dir):
    """A31"""
    return json_chunks(spark, sf_dir).groupBy("chunk").agg(F.count(F.lit(1)).alias("size"))


@query("corrupt_lines", "select doc_id % 10 <> 0 as good, count(*) as n from documents group by 1")
def corrupt_lines(spark, sf_dir):
    """Every tenth record is cut in the middle."""
    path = new_folder(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text"))
    cut = F.when(F.col("doc_id") % 10 == 0, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    table(spark, sf_dir, "documents").select(cut.alias("value")).write.text(path)
    good, bad = src.scan_lines(spark, path, "doc_id bigint, text string")
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count(F.lit(1)).alias("n"))


@query("envelope_scan", """select doc_id, md5(text) as body_md5, 0 as rejects from documents where doc_id % 10 <> 3
union all select null, null, count(*)::int from documents where doc_id % 10 = 3""")
def envelope_scan(spark, sf_dir):
    """Envelope files read in splits; every tenth record is cut in the middle, and counted."""
    path = new_folder(spark, "envelopes")
    record = F.to_json(F.struct(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.lit("{\"file\":").alias("method"), F.col("text").alias("body"), F.array(F.struct(F.lit("n").alias("node"))).alias("formalParam")))
    cut = F.when(F.col("doc_id") % 10 == 3, record.substr(F.lit(1), F.length(record) - 8)).otherwise(record)
    chunks = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 128).alias("chunk")).agg(F.collect_list(cut).alias("records"))
    text = F.concat(F.lit('{"size":'), F.size("records"), F.lit(',"programs":['), F.array_join("records", ",\n"), F.lit("]}"))
    chunks.select("chunk", text.alias("value")).repartition("chunk").write.partitionBy("chunk").text(path)
    good, bad = src.scan_large_envelopes(spark, path)
    rows = good.select(F.expr("substring(file, 2)").cast("bigint").alias("doc_id"), F.md5("body").alias("body_md5"), F.lit(0).alias("rejects"))
    none = F.lit(None)
    return rows.unionByName(bad.agg(F.count(F.lit(1)).cast("int").alias("rejects")).select(none.cast("bigint").alias("doc_id"), none.cast("string").alias("body_md5"), "rejects"))


@query("program_filters", """select count(*) as n_ast, count(*) filter (len > 30) as n_body, count(*) filter (marked) as n_marked from
 (select length(text) as len, contains(text, 'the') as marked from documents where doc_id % 7 <> 0)""")
def program_filters(spark, sf_dir):
    """P1–P3, P5, P6"""
    body = F.col("text")
    nodes = F.when(F.length(body) > 30, F.lit('{"_nodes":[{"node":"DReturnVar"}]}')).otherwise(F.lit('{"_nodes":[]}'))
    records = table(spark, sf_dir, "documents").select(
        "doc_id", body.alias("body"), F.when(F.col("doc_id") % 7 != 0, nodes).alias("ast"), F.lit(None).cast("string").alias("returnType"),
        F.lit("void").alias("inferred_return"), F.array().cast("array<string>").alias("formalParam"),
    )
    kept = src.has_ast(src.manipulated(records))
    found = kept.select(F.lit("ast").alias("rule")).unionByName(src.has_body(kept).select(F.lit("body").alias("rule"))).unionByName(
        src.marked(kept, "the").select(F.lit("marked").alias("rule"))
    )
    return found.agg(*[F.count_if(F.col("rule") == r).alias(f"n_{r}") for r in ("ast", "body", "marked")])


@query("path_names", "select page_id, 'out_' || replace(regexp_replace('.' || url, '^\\.', '/data'), '/', '_') || '.json' as name from pages")
def path_names(spark, sf_dir):
    """S5"""
    path = F.concat(F.lit("."), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", src.output_name(path, "/data", "out_", ".json").alias("name"))


@query("vocab_store", f"with {VOCAB.format(where='')} select 'keyword' as kind, token, id from vocab union all select 'keyword', '__delim__', 0")
def vocab_store(spark, sf_dir):
    """S10"""
    path = new_folder(spark, "vocab")
    stores.write_vocab(vocab.build_vocab(distinct_tokens(spark, sf_dir), "doc_id", "pos").withColumn("kind", F.lit("keyword")), path)
    return stores.read_vocab(spark, path, "keyword")


@query("unbalanced_tokens", f"with {VOCAB.format(where='')} select count(*) filter (length(replace(token, '<', '')) <> length(replace(token, '>', ''))) as bad, count(*) as n from vocab")
def unbalanced_tokens(spark, sf_dir):
    """A32"""
    built = vocab.build_vocab(distinct_tokens(spark, sf_dir), "doc_id", "pos")
    marked = vocab.unbalanced(built).select(F.lit(1).alias("bad")).unionByName(built.select(F.lit(0).alias("bad")))
    return marked.agg(F.sum("bad").cast("bigint").alias("bad"), F.count_if(F.col("bad") == 0).alias("n"))


@query("compat_store", f"with {SCOPE} select role, declared, usage from compat")
def compat_store(spark, sf_dir):
    """S11"""
    path = new_folder(spark, "compat")
    stores.write_compat(checks.learn_compat(uses_of_programs(spark, sf_dir)), path)
    return stores.read_compat(spark, path)


@query("encoded_store", ORACLE_ENCODED)
def encoded_store(spark, sf_dir):
    """Even and odd programs written apart and appended."""
    encoded = persist_table(encode_evidence(spark, sf_dir), "encoded")  # written apart twice, made once
    parts = []
    for rest in (0, 1):
        path = new_folder(spark, "encoded")
        stores.write_encoded(encoded.where(F.col("pid") % 2 == rest), path)
        parts.append(spark.read.schema(encoded.schema).parquet(path))
    return stores.append_encoded(*parts)


@query("embedding_store", "select vec_id as id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings")
def embedding_store(spark, sf_dir):
    """S17"""
    path = new_folder(spark, "embeddings")
    stores.write_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    back = spark.read.parquet(path)
    return back.select("id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("line_counts", "select lang, sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint as lines from documents group by lang")
def line_counts(spark, sf_dir):
    """S15, S16"""
    path = new_folder(spark, "text")
    table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").option("lineSep", "\n").text(path)
    per_file = stores.line_counts(spark.read.option("lineSep", "\n").text(path))
    lang = F.regexp_extract("file", "lang=([^/]*)/", 1)
    return per_file.groupBy(lang.alias("lang")).agg(F.sum("lines").alias("lines"))


@query("parallel_corpus", """with r as (select doc_id, ((row_number() over (order by doc_id) - 1) // 200)::int as chunk, len(string_split(lang, ',')) as c from documents)
select chunk, count(*) as bodies, count(*) as contexts from r group by chunk""")
def parallel_corpus(spark, sf_dir):
    """Body and context lines of each chunk."""
    path = new_folder(spark, "parallel")
    docs = src.file_chunks(table(spark, sf_dir, "documents"), "doc_id", 200)
    tokens = F.array_join(tx.code_tokens(F.col("text")), " ")
    stores.write_parallel_text(docs, tokens, F.concat_ws(" ", "lang", "source"), "doc_id", path)
    count = lambda name, out: spark.read.option("lineSep", "\n").text(f"{path}/{name}").groupBy("chunk").agg(F.count(F.lit(1)).alias(out))
    return count("body", "bodies").join(count("context", "contexts"), "chunk")


@query("parallel_lines", f"""with r as (select row_number() over (order by doc_id) - 1 as p, {TOKENS_SQL.replace('{0}', 'text')} as t, concat_ws(' ', lang, source) as c from documents)
select (p // 200)::int as chunk, (p % 200)::int as line, md5(coalesce(array_to_string(t, ' '), '')) as body_md5, md5(c) as context_md5 from r""")
def parallel_lines(spark, sf_dir):
    """Body and context files whose lines belong together, by text and after a check of the files against their index."""
    path, names = new_folder(spark, "aligned"), ["body", "context"]
    tokens = F.array_join(tx.code_tokens(F.col("text")), " ")
    aligned.write_aligned(table(spark, sf_dir, "documents"), {"body": tokens, "context": F.concat_ws(" ", "lang", "source")}, "doc_id", path, 200)
    lines = aligned.read_aligned(spark, path, names).join(aligned.misaligned(spark, path, names), "chunk", "left_anti")
    return lines.select("chunk", "line", *[F.md5(n).alias(f"{n}_md5") for n in names])


@query("batch_feed", """with r as (select e.epoch, doc_id, row_number() over (partition by e.epoch order by md5(12 + e.epoch || ':' || doc_id), doc_id) - 1 as pos, count(*) over (partition by e.epoch) as n
  from documents, (select unnest([0, 1, 2]) as epoch) e)
select epoch::int as epoch, pos // 16 as batch_id, count(*) as rows, md5(string_agg(doc_id, ',' order by pos)) as ids_md5 from r where pos < (n // 16) * 16 group by all""")
def batch_feed(spark, sf_dir):
    """Three epochs of batches; a reader stops in the second and another goes on from its place."""
    path = new_folder(spark, "epochs")
    epochs.write_epochs(table(spark, sf_dir, "documents").select("doc_id"), path, 3, 16, 12, "doc_id")

    def digest(batch):
        ids = hashlib.md5(",".join(map(str, batch["doc_id"])).encode()).hexdigest()
        return pd.DataFrame({"epoch": [batch["epoch"][0]], "batch_id": [batch["batch_id"][0]], "rows": [len(batch)], "ids_md5": [ids]})

    schema = "epoch int, batch_id bigint, rows bigint, ids_md5 string"
    first = epochs.EpochFeed(spark, path)
    some = first.batches + first.batches // 2
    before = persist_table(first.each(digest, schema, batches=some), "digests")
    first.keep_place("digest", first.after((0, 0), some))
    again = epochs.EpochFeed(spark, path)
    return before.unionByName(again.each(digest, schema, again.place("digest")))


@query("report_text", """select (select count(distinct conv_id) from conversations where role = 'user') as programs,
 (select count(*) from conversations c where role = 'assistant' and conv_id in (select conv_id from conversations where role = 'user')) as predictions""")
def report_text(spark, sf_dir):
    """S13, S18"""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pid"), "turn", "role", "text")
    truth = said.where("role = 'user'").groupBy("pid").agg(F.min_by("text", "turn").alias("truth"))
    guesses = said.where("role = 'assistant'").join(truth.select("pid"), "pid", "left_semi").select("pid", F.col("turn").alias("rank"), F.col("text").alias("candidate"))
    path = new_folder(spark, "report")
    stores.write_report(stores.report_lines(truth, guesses), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.agg(F.count_if(F.col("value") == "== truth ==").alias("programs"), F.count_if(F.col("value") == "== end of prediction ==").alias("predictions"))


# --- stores that grow ------------------------------------------------------------------

DELIVERIES = 3


def _delivery(id_col):
    return F.pmod(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4), 16, 10).cast("int"), F.lit(DELIVERIES))


def _sql_delivery(id_col):
    return f"('0x' || substr(md5({id_col}::varchar), 1, 4))::int % {DELIVERIES}"


@query("vocab_growth", f"""with {TOKENS}, f as (select token, min(({_sql_delivery('doc_id')}, doc_id, pos)) as first from tokens group by token)
select token, row_number() over (order by first, token) as id, (first[1] + 1)::bigint as version from f""")
def vocab_growth(spark, sf_dir):
    """A vocabulary that takes in the documents in three deliveries; ids that were given out stay."""
    tokens = distinct_tokens(spark, sf_dir)
    store = GrowingStore(spark, new_folder(spark, "growing"), "token string", numbered=True).create()
    for number in range(DELIVERIES):
        store.merge(tokens.where(_delivery("doc_id") == number), ["doc_id", "pos"], F.floor(F.col("doc_id") / vocab.DOC_BLOCK))
    return store.read()


@query("vocab_infer", f"""with {TOKENS}, f as (select token, min((doc_id, pos)) as first from tokens where {_sql_delivery('doc_id')} = 0 group by token),
v as (select token, row_number() over (order by first, token) as id from f)
select doc_id, count(*) as n_tokens, count(*) filter (id is null) as n_unknown, sum(coalesce(id, 0))::bigint as id_sum from tokens left join v using (token) group by doc_id""")
def vocab_infer(spark, sf_dir):
    """P20: all documents in inferring mode, with the first version of a store that has grown since."""
    tokens = distinct_tokens(spark, sf_dir)
    store = GrowingStore(spark, new_folder(spark, "growing"), "token string", numbered=True).create()
    for number in range(2):
        store.merge(tokens.where(_delivery("doc_id") == number), ["doc_id", "pos"], F.floor(F.col("doc_id") / vocab.DOC_BLOCK))
    every = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("token"))
    coded = store.encode(every, version=1)
    return coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("id") == 0).alias("n_unknown"), F.sum("id").alias("id_sum"))


@query("compat_growth", f"""with {SCOPE} select role, declared, usage, (min({_sql_delivery('pid')}) + 1)::bigint as version from typed where found and not exempt group by role, declared, usage""")
def compat_growth(spark, sf_dir):
    """S11, A7 in update mode: the relation takes in the programs in three deliveries."""
    uses = persist_table(uses_of_programs(spark, sf_dir), "uses")
    store = GrowingStore(spark, new_folder(spark, "growing"), stores.COMPAT).create()
    for number in range(DELIVERIES):
        store.merge(checks.learn_compat(uses.where(_delivery("pid") == number)))
    return store.read()


# --- streams ---------------------------------------------------------------------------

@query("stream_dedup", "select distinct user_id, event_type, ts::date as day from events")
def stream_dedup(spark, sf_dir):
    """Z1, Z2"""
    stream = ingest.watch_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = ingest.without_repeats(stream, "ts", ["user_id", "event_type", "day"], "2 days")
    return ingest.run_append(kept.select("user_id", "event_type", "day"), "dedup")


@query("stream_windows", "select date_trunc('hour', ts) as start, event_type as reason, count(*) as n from events group by all")
def stream_windows(spark, sf_dir):
    """Z3, tumbling"""
    counts = ingest.windowed_counts(ingest.watch_table(spark, sf_dir, "events"), "ts", F.col("event_type"), "10 minutes", "1 hour")
    return ingest.run_update(counts, "windows", ["start", "reason"])


@query("stream_sliding", """select time_bucket(interval 30 minutes, ts) - s.d * interval 30 minutes as start, event_type as reason, count(*) as n
from events, (select unnest([0, 1]) as d) s group by all""")
def stream_sliding(spark, sf_dir):
    """Z3, sliding"""
    counts = ingest.windowed_counts(ingest.watch_table(spark, sf_dir, "events"), "ts", F.col("event_type"), "10 minutes", "1 hour", "30 minutes")
    return ingest.run_update(counts, "sliding", ["start", "reason"])


ARRIVAL = """e as (select event_type as reason, epoch_ms(ts) as ms, time_bucket(interval 6 hours, ts) as start, value >= 50 as refused,
  least(3, (day(ts) - 1) // 8 + case when event_id % 9 = 0 then 1 else 0 end) as batch from events),
mark as (select batch, max(max(ms)) over (order by batch rows between unbounded preceding and 1 preceding) - 86400000 as wm, max(max(ms)) over () - 86400000 as last_wm from e group by batch),
j as (select e.*, epoch_ms(start) + 21600000 as ending, coalesce(epoch_ms(start) + 21600000 <= wm, false) as is_late, last_wm from e join mark using (batch))"""


@query("stream_late", f"""with {ARRIVAL} select case when is_late then 'late' when ending < last_wm then 'closed' else 'open' end as kind, reason, start, count(*) as n from j where not refused group by all
union all select 'reject', 'outlier', null, count(*) from j where refused having count(*) > 0""")
def stream_late(spark, sf_dir):
    """Events arrive in four deliveries out of order, the stream is stopped between them; late and refused rows are counted."""
    events = table(spark, sf_dir, "events")
    delivery = F.floor((F.dayofmonth("ts") - 1) / 8) + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)
    dealt = events.withColumn("_delivery", F.least(F.lit(3), delivery))
    folder = new_folder(spark, "arrivals")
    stream = late.LateCounts(spark, folder, events.schema, "ts", F.col("event_type"), "1 day", timedelta(hours=6), F.when(F.col("value") >= 50, "outlier"))
    for number in range(4):
        dealt.where(F.col("_delivery") == number).drop("_delivery").write.mode("append").parquet(folder)
        stream.run()
    return stream.result()
