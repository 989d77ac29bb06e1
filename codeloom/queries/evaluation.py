"""Predictions against the truth, hit rates, clusters, vectors and beams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scores as sc, text as tx
from codeloom.operators import accuracy, beam, clusters, ranking, similarity
from codeloom.queries.registry import query
from codeloom.queries.sqlparts import CALLS
from codeloom.session import table

WORD_LIST = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')"
BEAMS = f"""said as (select conv_id as pid, turn, role, {WORD_LIST} as w from conversations),
truth as (select pid, arg_min(w, turn) as t from said where role = 'user' group by pid),
cand as (select pid, turn as rank, w as c from said where role = 'assistant'),
bi as (select pid, rank, t, c, list_distinct(t) as t1, list_distinct(c) as c1,
  list_distinct(list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda z: z[1] || ' ' || z[2])) as t2,
  list_distinct(list_transform(list_zip(c[1:len(c) - 1], c[2:len(c)]), lambda z: z[1] || ' ' || z[2])) as c2 from cand join truth using (pid)),
scored as (select *, """ + ", ".join(
    f"case when len(t{n}) + len(c{n}) = 0 then 1.0 else len(list_intersect(t{n}, c{n})) / (len(t{n}) + len(c{n}) - len(list_intersect(t{n}, c{n})))::double end as {name}"
    for n, name in ((1, "sim_set"), (2, "sim_seq"))) + """, (t = c)::int::double as sim_whole from bi),
best as (select pid, len(any_value(t1)) as n_items, max(sim_set) as sim_set, max(sim_seq) as sim_seq, max(sim_whole) as sim_whole
  from scored where len(t) + len(c) > 0 group by pid)"""


def truth_and_candidates(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pid"), "turn", "role", tx.words(F.col("text")).alias("w"))
    truth = said.where("role = 'user'").groupBy("pid").agg(F.min_by("w", "turn").alias("truth_tokens"))
    cand = said.where("role = 'assistant'").select("pid", F.col("turn").alias("rank"), F.col("w").alias("cand_tokens"))
    return truth, cand


def scored_pairs(spark, sf_dir):
    return similarity.similarities(similarity.pair(*truth_and_candidates(spark, sf_dir)))


def best(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir).withColumn("n_items", F.size(F.array_distinct("truth_tokens")))
    return similarity.best_of_beam(scored, keep=["n_items"])


ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in similarity.METRICS)


@query("jaccard_pairs", f"with {BEAMS} select pid, rank, {ROUNDED} from scored")
def jaccard_pairs(spark, sf_dir):
    """U3, J11"""
    return scored_pairs(spark, sf_dir).select("pid", "rank", *[F.round(m, 6).alias(m) for m in similarity.METRICS])


@query("jaccard_range", f"""with {BEAMS} select round(min(sim_set), 6) as lowest, round(max(sim_set), 6) as highest, round(avg(sim_set), 6) as mean,
  round(sum(len(t1)) / (count(*) + 0.00001), 6) as mean_items from scored""")
def jaccard_range(spark, sf_dir):
    """A18"""
    s = scored_pairs(spark, sf_dir).withColumn("k", F.size(F.array_distinct("truth_tokens")))
    return s.agg(
        F.round(F.min("sim_set"), 6).alias("lowest"), F.round(F.max("sim_set"), 6).alias("highest"), F.round(F.avg("sim_set"), 6).alias("mean"),
        F.round(F.sum("k") / (F.count(F.lit(1)) + 0.00001), 6).alias("mean_items"),
    )


@query("best_of_beam", f"with {BEAMS} select pid, {ROUNDED} from best")
def best_of_beam(spark, sf_dir):
    """A15"""
    return best(spark, sf_dir).select("pid", *[F.round(m, 6).alias(m) for m in similarity.METRICS])


@query("mean_best", f"with {BEAMS} select " + ", ".join(f"round(sum({m}) / (count(*) + 0.00001), 6) as {m}" for m in similarity.METRICS) + " from best")
def mean_best(spark, sf_dir):
    """A16"""
    return similarity.mean_best(best(spark, sf_dir)).select(*[F.round(m, 6).alias(m) for m in similarity.METRICS])


@query("similarity_by_length", f"with {BEAMS} select n_items::int as n_items, count(*) as n, round(sum(sim_set), 6) as total, round(avg(sim_set), 6) as mean from best group by n_items")
def similarity_by_length(spark, sf_dir):
    """A17"""
    out = similarity.by_length(best(spark, sf_dir), "n_items")
    return out.select("n_items", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean")).orderBy("n_items")


def _bleu_sql() -> str:
    lines = []
    for i, w in enumerate(similarity.BLEU_WEIGHTS):
        logs = " + ".join(f"{x} * ln(case when coalesce(p{n}, 0) > 0 then p{n} else 2.2250738585072014e-308 end)" for n, x in enumerate(w, 1) if x)
        lines.append(f"""case when hyp_len = 0 or coalesce(p1, 0) = 0 then 0.0 else
  (case when hyp_len > ref_len then 1.0 else exp(1 - ref_len / hyp_len::double) end) * exp({logs}) end as bleu_{i}""")
    grams = lambda v: " union all ".join(
        f"select pid{', rank' if v == 'c' else ''}, {n} as n, unnest(list_transform(range(1, len({v}) - {n - 2}), lambda i: array_to_string({v}[i:i + {n - 1}], ' '))) as gram from {'cand' if v == 'c' else 'truth'} where len({v}) >= {n}"
        for n in (1, 2, 3))
    return f"""with {BEAMS},
have as (select pid, rank, n, gram, count(*) as c from ({grams('c')}) group by all),
want as (select pid, n, gram, count(*) as r from ({grams('t')}) group by all),
per as (select pid, rank, n, sum(least(c, coalesce(r, 0))) / sum(c)::double as p from have left join want using (pid, n, gram) group by all),
wide as (select pid, rank, max(p) filter (n = 1) as p1, max(p) filter (n = 2) as p2, max(p) filter (n = 3) as p3 from per group by all),
sizes as (select pid, rank, len(t) as ref_len, len(c) as hyp_len from cand join truth using (pid)),
bleu as (select pid, rank, {', '.join(lines)} from sizes left join wide using (pid, rank))"""


@query("bleu_pairs", _bleu_sql() + " select pid, rank, " + ", ".join(f"round(bleu_{i}, 6) as bleu_{i}" for i in range(4)) + " from bleu")
def bleu_pairs(spark, sf_dir):
    """F27"""
    scores = similarity.bleu(*truth_and_candidates(spark, sf_dir))
    return scores.select("pid", "rank", *[F.round(f"bleu_{i}", 6).alias(f"bleu_{i}") for i in range(4)])


@query("bleu_averages", _bleu_sql() + ", m as (select pid, " + ", ".join(f"max(bleu_{i}) as b{i}" for i in range(4)) + " from bleu group by pid) select "
       + ", ".join(f"(select round(avg(b{i}), 6) from m) as avg_max_bleu_{i}, round(avg(bleu_{i}), 6) as avg_bleu_{i}" for i in range(4)) + " from bleu")
def bleu_averages(spark, sf_dir):
    """A22"""
    out = similarity.bleu_averages(similarity.bleu(*truth_and_candidates(spark, sf_dir)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def hour_bucket():
    """Rises with ts."""
    return F.substring(F.col("ts").cast("string"), 1, 13)


# --- scored steps: events, category = type, position = place in the user's stream --------

STEPS = """steps as (select event_type as category, user_id, event_id, ts, (props->>'$.k')::int % 2 as hit, cast(value as decimal(18,4)) as prob,
  row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)"""


def steps(spark, sf_dir, with_pos=True):
    events = table(spark, sf_dir, "events")
    cols = [
        F.col("event_type").alias("category"), "user_id", "event_id", "ts", (F.get_json_object("props", "$.k").cast("int") % 2).alias("hit"),
        F.col("value").cast("decimal(18,4)").alias("prob"),
    ]
    flat = events.select(*cols)
    if not with_pos:
        return flat
    return ranking.positions(flat, [F.col("ts"), F.col("event_id")], hour_bucket(), keys=["user_id"])


@query("category_accuracy", f"""with {STEPS}, c as (select category, sum(hit) as hits, count(*) as n from steps group by category),
a as (select * from c union all select 'all', sum(hits), sum(n) from c union all select 'all_but_concept', sum(hits), sum(n) from c where category <> 'view')
select category, hits::bigint as hits, n::bigint as n, round(hits / n::double, 6) as accuracy from a""")
def category_accuracy(spark, sf_dir):
    """A19, A21"""
    return accuracy.by_category(steps(spark, sf_dir, False), "view").withColumn("accuracy", F.round("accuracy", 6))


POSITIONS = f"""{STEPS}, p as (select pos, count(*) as n, sum(hit) as hits, sum(case when hit = 1 then prob else 0 end) as mass
  from steps where category <> 'view' group by pos)"""


@query("position_accuracy", f"with {POSITIONS} select pos, n, hits::bigint as hits, round(hits / n::double, 6) as hit_share, round(mass::double / n, 6) as prob_share from p")
def position_accuracy(spark, sf_dir):
    """A20, P19, T12"""
    out = accuracy.by_position(steps(spark, sf_dir), exclude=["view"])
    return out.select("pos", "n", "hits", F.round("hit_share", 6).alias("hit_share"), F.round(F.col("prob_mass").cast("double") / F.col("n"), 6).alias("prob_share")).orderBy("pos")


@query("cumulative_log", f"with {POSITIONS} select pos, round(hits / n::double, 6) as hit_share, round(sum(ln(hits / n::double + 0.00001)) over (order by pos), 5) as cum_log from p")
def cumulative_log(spark, sf_dir):
    """W8, P18"""
    shares = accuracy.by_position(steps(spark, sf_dir), exclude=["view"]).select("pos", "hit_share")
    return accuracy.cumulative_log(shares).select("pos", F.round("hit_share", 6).alias("hit_share"), F.round("cum_log", 5).alias("cum_log"))


@query("inference_horizon", f"""with {STEPS}, c as (select category, pos as length, count(*) as n, sum(prob) as s from steps group by all),
a as (select * from c union all select 'all', length, n, s from c union all select 'all_but_concept', length, n, s from c where category <> 'view')
select category, length, sum(n)::bigint as n, round(sum(s)::double, 4) as prob_sum from a group by all""")
def inference_horizon(spark, sf_dir):
    """A26"""
    s = steps(spark, sf_dir).select("category", F.col("pos").alias("length"), F.col("prob").alias("max_prob"))
    return accuracy.horizon(s, "view").withColumn("prob_sum", F.round(F.col("prob_sum").cast("double"), 4))


@query("access_counts", """select event_type as var_id, count(*) as accesses, count(*) filter ((props->>'$.k')::int % 2 = 1) as successful from events group by 1""")
def access_counts(spark, sf_dir):
    """A11"""
    return steps(spark, sf_dir, False).groupBy(F.col("category").alias("var_id")).agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("hit") == 1).alias("successful")
    )


# --- beams -----------------------------------------------------------------------------

@query("beam_topk", """with s as (select user_id as pid, event_type, event_id, ts,
   round((ln(abs(value) / 1000 + 0.01) + -0.5 * power(hour(ts) + 1, 0.7)) / power(hour(ts) + 2, 0.7), 9) as score from events),
 m as (select *, case when event_type in ('click', 'view') then score else -1e300 end as sc from s),
 r as (select pid, event_id, score, row_number() over (partition by pid order by sc desc, event_id) as rank, sc from m)
select pid, rank::int as rank, event_id, score from r where rank <= 5 and sc > -1e300""")
def beam_topk(spark, sf_dir):
    """Normalised scores, disallowed tokens at -inf, best k per program."""
    events = table(spark, sf_dir, "events")
    length = F.hour("ts") + 1
    score = F.round(sc.length_normalised(F.ln(F.abs("value") / 1000 + 0.01), F.lit(-0.5), length, F.lit(1)), 9)
    scored = events.select(F.col("user_id").alias("pid"), F.col("event_id").alias("candidate"), "event_type", score.alias("score"))
    allowed = spark.createDataFrame([("click",), ("view",)], "event_type string")
    kept = beam.best_candidates(beam.constrain(scored, allowed, ["event_type"]), 5)
    return kept.where(F.col("score") > float("-inf")).select("pid", "rank", F.col("candidate").alias("event_id"), "score")


ROUNDS, WIDTH, STOP = 5, 4, "purchase"


def _beam_sql() -> str:
    sql = """with e as (select user_id as pid, event_type as token, lag(event_type) over (partition by user_id order by ts, event_id) as last from events),
kinds as (select distinct event_type as kind from events), users as (select distinct user_id as pid from events),
n as (select pid, last, token, count(*) as c from e where last is not null group by all),
steps as (select u.pid, a.kind as last, b.kind as token, ln((coalesce(c, 0) + 1.0) / (coalesce((select sum(c) from n m where m.pid = u.pid and m.last = a.kind), 0) + (select count(*) from kinds))) as ln_prob
  from users u cross join kinds a cross join kinds b left join n on n.pid = u.pid and n.last = a.kind and n.token = b.kind),
b0 as (select user_id as pid, arg_min(event_type, (ts, event_id)) as last, arg_min(event_type, (ts, event_id)) as seq, 0.0::double as logp, 1 as length, true as rolling from events group by 1)"""
    for i in range(1, ROUNDS + 1):
        sql += f""",
g{i} as (select pid, token as last, seq || '>' || token as seq, round((ln_prob + logp * power(length, 0.7)) / power(length + 1, 0.7), 9) as logp, length + 1 as length, token <> '{STOP}' as rolling
  from b{i - 1} join steps using (pid, last) where rolling union all select pid, last, seq, logp, length, rolling from b{i - 1} where not rolling),
b{i} as (select pid, last, seq, logp, length, rolling from (select *, row_number() over (partition by pid order by logp desc, seq) as r from g{i}) where r <= {WIDTH})"""
    return sql + f" select pid, seq, round(logp, 6) as logp, length, rolling, (row_number() over (partition by pid order by logp desc, seq))::int as rank from b{ROUNDS}"


@query("beam_search", _beam_sql())
def beam_search(spark, sf_dir):
    """M5: steps scored by each user's own transitions, add-one smoothed; ``rolling`` beams had not stopped after the rounds."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), F.col("event_type").alias("token"), "ts", "event_id")
    placed = ranking.positions(events, [F.col("ts"), F.col("event_id")], hour_bucket(), keys=["pid"])
    after = placed.select("pid", "token", (F.col("pos") - 1).alias("pos"))
    pairs = placed.select("pid", "pos", F.col("token").alias("last")).join(after, ["pid", "pos"]).groupBy("pid", "last", "token").agg(F.count(F.lit(1)).alias("c"))
    kinds = events.agg(F.array_sort(F.collect_set("token")).alias("kinds")).scalar()  # the event types of the data, one short list
    users = events.select("pid").distinct().withColumn("kinds", kinds)
    grid = users.select("pid", "kinds", F.explode("kinds").alias("last")).select("pid", F.size("kinds").alias("n_kinds"), "last", F.explode("kinds").alias("token"))
    counted = grid.join(pairs, ["pid", "last", "token"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(W.partitionBy("pid", "last"))  # one row per event type
    moves = counted.select("pid", "last", "token", F.ln((F.col("c") + 1.0) / (total + F.col("n_kinds"))).alias("ln_prob"))
    first = events.groupBy("pid").agg(F.min_by("token", F.struct("ts", "event_id")).alias("last"))
    starts = first.select("pid", "last", F.col("last").alias("seq"), F.lit(0.0).alias("logp"), F.lit(1).alias("length"), F.lit(True).alias("rolling"))
    found = beam.beam_search(starts, beam.persist_table(moves, "moves"), WIDTH, STOP, ROUNDS)
    return found.select("pid", "seq", F.round("logp", 6).alias("logp"), "length", "rolling", "rank")


# --- vectors and clusters ----------------------------------------------------------------

def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector")
    )


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    """M1"""
    return clusters.kmeans(vectors(spark, sf_dir).select("id", "vector")).select("id", "cluster")


@query("pca_2d")
def pca_2d(spark, sf_dir):
    """M4"""
    return clusters.two_dimensional(vectors(spark, sf_dir)).select("id", "cluster", "x", "y")


MEMBER = "members as (select vec_id as id, label as cluster, list_filter(range(1, 65), lambda i: embedding[i] > 0.15::float) as items, row_number() over (partition by label order by vec_id) as r from embeddings)"
AVERAGES = f"""{MEMBER}, kept as (select * from members where r <= 201),
pairs as (select a.cluster as i, b.cluster as j, case when len(a.items) + len(b.items) = 0 then 1.0 else
    len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::double end as s
  from kept a join kept b on a.cluster < b.cluster or (a.cluster = b.cluster and a.id < b.id)),
averages as (select i, j, case when i = j then sum(s) / (0.001 + count(*)) else sum(s) / (count(*) + 0.0001) end as avg from pairs group by i, j)"""


def members(spark, sf_dir):
    items = F.filter(F.transform("embedding", lambda x, i: F.when(x > F.lit(0.15).cast("float"), i + 1)), lambda i: i.isNotNull())
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), items.alias("items"))


@query("cluster_cap", f"with {MEMBER} select id, cluster from members where r <= 201")
def cluster_cap(spark, sf_dir):
    """W9"""
    return clusters.cap_members(members(spark, sf_dir)).select("id", "cluster")


@query("intra_inter_jaccard", f"with {AVERAGES} select i, j, round(avg, 6) as avg from averages")
def intra_inter_jaccard(spark, sf_dir):
    """J14, J15, A23, A24, S19"""
    return clusters.mean_jaccard(members(spark, sf_dir)).select("i", "j", F.round("avg", 6).alias("avg"))


@query("cluster_matrix", f"""with {AVERAGES}, m as (select i, j, avg from averages union all select j, i, avg from averages where i <> j)
select i, j, round(avg, 6) as avg from m""")
def cluster_matrix(spark, sf_dir):
    """A25"""
    return clusters.matrix(clusters.mean_jaccard(members(spark, sf_dir))).select("i", "j", F.round("avg", 6).alias("avg"))


@query("clusters_by_cohesion", f"with {AVERAGES} select i as cluster, round(avg, 6) as avg from averages where i = j order by avg desc, i")
def clusters_by_cohesion(spark, sf_dir):
    """T11"""
    return clusters.by_cohesion(clusters.mean_jaccard(members(spark, sf_dir))).withColumn("avg", F.round("avg", 6))


@query("matrix_text", f"""with {AVERAGES}, m as (select i, j, avg from averages union all select j, i, avg from averages where i <> j)
select i, '[' || string_agg(printf('%.3f', round(avg, 3)), ', ' order by j) || ']' as line from m group by i""")
def matrix_text(spark, sf_dir):
    """F37"""
    return clusters.matrix_lines(clusters.mean_jaccard(members(spark, sf_dir)))


@query("label_sizes", "select label, count(*) as n from embeddings group by label order by n desc, label")
def label_sizes(spark, sf_dir):
    """A27"""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


LOGITS = "l as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@query("argmax_hits", f"""with {LOGITS} select vec_id, (list_position(v, list_max(v)) - 1 = label)::int as hit,
  round(v[label + 1] - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) as ln_prob from l""")
def argmax_hits(spark, sf_dir):
    """M2, M3"""
    v = vectors(spark, sf_dir).withColumnRenamed("vector", "v")
    return v.select(
        F.col("id").alias("vec_id"), (sc.argmax(F.col("v")) == F.col("cluster")).cast("int").alias("hit"),
        F.round(F.get(sc.log_softmax(F.col("v")), F.col("cluster")), 6).alias("ln_prob"),
    )


@query("top_scores", f"""with {LOGITS}, u as (select vec_id, generate_subscripts(v, 1) - 1 as i, unnest(v) as x, v from l),
s as (select vec_id, i, x - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) as s from u),
r as (select *, row_number() over (partition by vec_id order by s desc, i) as r from s)
select vec_id, array_to_string(list_resize(list(i order by r), 66, 1), ',') as idx, round(sum(s) - 40000, 4) as total from r group by vec_id""")
def top_scores(spark, sf_dir):
    """64 candidates, 66 wanted."""
    v = vectors(spark, sf_dir).withColumnRenamed("vector", "v")
    values, idx = sc.top_scores(F.col("v"), 66)
    return v.select(F.col("id").alias("vec_id"), F.array_join(idx, ",").alias("idx"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


SIGMAS = (1.0, 0.5, 2.0, 1.5)


def _fusion_sql() -> str:
    ev = ", ".join(f"case when vec_id % {j + 2} = 0 then 0 else 1.0 / {s * s} end as w{j}" for j, s in enumerate(SIGMAS))
    num = " + ".join(f"w{j} * embedding[{16 * j} + d]::double" for j in range(4))
    den = "(1 + " + " + ".join(f"w{j}" for j in range(4)) + ")"
    return f"""with w as (select vec_id, embedding, {ev} from embeddings), d as (select vec_id, d, ({num}) / {den} as m, 1.0 / {den} as covar from w, (select unnest(range(1, 17)) as d))
select vec_id, round(max(covar), 6) as covar, round(sum(m), 6) as mean_sum, round(max(m), 6) as mean_max from d group by vec_id"""


@query("precision_fusion", _fusion_sql())
def precision_fusion(spark, sf_dir):
    """Four pieces of evidence, some absent."""
    v = vectors(spark, sf_dir)
    pieces = [
        F.when(F.col("id") % (j + 2) == 0, F.array_repeat(F.lit(0.0), 16)).otherwise(F.slice("vector", 16 * j + 1, 16)) for j in range(4)
    ]
    mean, covar = sc.fuse(pieces, list(SIGMAS))
    fused = v.select("id", mean.alias("m"), covar.alias("covar"))
    return fused.select(
        F.col("id").alias("vec_id"), F.round("covar", 6).alias("covar"),
        F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"), F.round(F.array_max("m"), 6).alias("mean_max"),
    )


@query("evidence_mask", """with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings),
k as (select vec_id, x, (('0x' || substr(md5('12:' || vec_id || ':' || i), 1, 8))::bigint / 4294967296.0) > 0.3 as keep from e)
select vec_id, (count(*) filter (keep and x <> 0))::int as kept, round(sum(case when keep then x else 0 end), 5) as total from k group by vec_id""")
def evidence_mask(spark, sf_dir):
    """F35, F36"""
    masked = vectors(spark, sf_dir).select("id", sc.drop_masked(F.col("vector"), 12, F.col("id"), 0.3).alias("m"))
    return masked.select(
        F.col("id").alias("vec_id"), F.size(F.filter("m", lambda x: x != 0)).alias("kept"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 5).alias("total")
    )
