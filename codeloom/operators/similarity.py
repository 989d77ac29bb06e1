"""Predictions against the truth: best of each beam, averages, BLEU."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.scores import jaccard, ngrams

# Weights of 1- to 4-gram precision.
BLEU_WEIGHTS = ((1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.5, 0.25, 0.25, 0.0))
TINY = 2.2250738585072014e-308


def pair(truth: DataFrame, candidates: DataFrame, key: str = "pid") -> DataFrame:
    """One truth per key to many candidates. AQE splits the partition of a hot key."""
    return candidates.join(truth, key)


def similarities(pairs: DataFrame) -> DataFrame:
    """Over ``truth_tokens`` and ``cand_tokens``: single elements, pairs in a row, calls only, whole."""
    bigram = lambda c: F.array_distinct(ngrams(F.col(c), 2))
    single = lambda c: F.array_distinct(F.col(c))
    return pairs.select(
        "*",
        jaccard(single("truth_tokens"), single("cand_tokens")).alias("sim_set"),
        jaccard(bigram("truth_tokens"), bigram("cand_tokens")).alias("sim_seq"),
        (F.col("truth_tokens") == F.col("cand_tokens")).cast("double").alias("sim_whole"),
        (F.size("truth_tokens") + F.size("cand_tokens") > 0).alias("valid"),
    )


METRICS = ("sim_set", "sim_seq", "sim_whole")


def best_of_beam(scored: DataFrame, key: str = "pid", keep: Sequence[str] = ()) -> DataFrame:
    ok = scored.where("valid")
    return ok.groupBy(key, *keep).agg(*[F.max(m).alias(m) for m in METRICS])


def mean_best(best: DataFrame) -> DataFrame:
    return best.agg(*[(F.sum(m) / (F.count(F.lit(1)) + 0.00001)).alias(m) for m in METRICS])


def by_length(best: DataFrame, length: str) -> DataFrame:
    return best.groupBy(length).agg(F.count(F.lit(1)).alias("n"), F.sum("sim_set").alias("total"), F.avg("sim_set").alias("mean"))


def gram_counts(df: DataFrame, keys: Sequence[str], tokens: str, max_n: int) -> DataFrame:
    def labelled(n: int) -> Column:
        return F.transform(ngrams(F.col(tokens), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.flatten(F.array(*[labelled(n) for n in range(1, max_n + 1)]))
    return df.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(
        F.count(F.lit(1)).alias("c")
    )


def bleu(truth: DataFrame, candidates: DataFrame, weights=BLEU_WEIGHTS, key: str = "pid", rank: str = "rank") -> DataFrame:
    """``pid, rank, bleu_0…``: one score per weight vector, one reference each.

    N-gram counts meet on (pid, n, gram), so no pair of texts is held in one row twice over and
    a long or often predicted text spreads over many keys.
    """
    max_n = max(i + 1 for w in weights for i, x in enumerate(w) if x > 0)
    have = gram_counts(candidates, [key, rank], "cand_tokens", max_n)
    want = gram_counts(truth, [key], "truth_tokens", max_n).withColumnRenamed("c", "r")
    clipped = have.join(want, [key, "n", "gram"], "left")
    hit = F.sum(F.least("c", F.coalesce("r", F.lit(0))))
    per_n = clipped.groupBy(key, rank, "n").agg(hit.alias("hit"), F.sum("c").alias("total"))
    wide = per_n.groupBy(key, rank).agg(*[
        F.max(F.when(F.col("n") == n, F.col("hit") / F.greatest("total", F.lit(1)))).alias(f"p{n}") for n in range(1, max_n + 1)
    ])
    sizes = pair(truth.select(key, F.size("truth_tokens").alias("ref_len")), candidates.select(key, rank, F.size("cand_tokens").alias("hyp_len")), key)
    scored = sizes.join(wide, [key, rank], "left")
    brevity = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))

    def score(weight) -> Column:
        logs = F.lit(0.0)
        for n, x in enumerate(weight, 1):
            if x > 0:
                p = F.coalesce(f"p{n}", F.lit(0.0))
                logs = logs + x * F.ln(F.when(p > 0, p).otherwise(F.lit(TINY)))
        return F.when((F.col("hyp_len") == 0) | (F.coalesce("p1", F.lit(0.0)) == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs))

    return scored.select(key, rank, *[score(w).alias(f"bleu_{i}") for i, w in enumerate(weights)])


def bleu_averages(scores: DataFrame, key: str = "pid") -> DataFrame:
    """Mean of the best per program, and mean over all predictions."""
    names = [c for c in scores.columns if c.startswith("bleu_")]
    per = scores.groupBy(key).agg(
        F.count(F.lit(1)).alias("k"), *[F.max(n).alias(f"max_{n}") for n in names], *[F.sum(n).alias(f"sum_{n}") for n in names]
    )
    return per.agg(
        *[F.avg(f"max_{n}").alias(f"avg_max_{n}") for n in names],
        *[(F.sum(f"sum_{n}") / F.sum("k")).alias(f"avg_{n}") for n in names],
    )
