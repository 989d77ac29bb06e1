"""Beam search over a table of step scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.scores import length_normalised
from codeloom.operators.ranking import top_k
from codeloom.session import persist_table

MAX_LENGTH = 128


def best_candidates(scores: DataFrame, k: int, score: str = "score", key: str = "pid", tie: str = "candidate") -> DataFrame:
    """The best k of all expansions of a program."""
    salt = F.pmod(F.xxhash64(tie), F.lit(64))
    return top_k(scores, [key], [F.desc(score), F.col(tie)], k, salt)


def constrain(scores: DataFrame, allowed: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """Score of a candidate outside its allowed list becomes -inf."""
    marked = scores.join(allowed.select(*on).distinct().withColumn("_ok", F.lit(True)), on, "left")
    return marked.withColumn(score, F.when(F.col("_ok"), F.col(score)).otherwise(F.lit(float("-inf")))).drop("_ok")


def expand(beams: DataFrame, steps: DataFrame, k: int, stop: str) -> DataFrame:
    """One round: every rolling beam takes each next token, a finished one stays as it is.

    ``beams``: pid, last, seq, logp, length, rolling. ``steps``: pid, last, token, ln_prob.
    """
    rolling = beams.where("rolling").join(steps, ["pid", "last"])
    grown = rolling.select(
        "pid", F.col("token").alias("last"), F.concat_ws(">", "seq", "token").alias("seq"),
        F.round(length_normalised(F.col("ln_prob"), F.col("logp"), F.col("length"), F.lit(1)), 9).alias("logp"),
        (F.col("length") + 1).alias("length"), (F.col("token") != stop).alias("rolling"),
    )
    return best_candidates(grown.unionByName(beams.where(~F.col("rolling"))), k, "logp", "pid", "seq").drop("rank")


def beam_search(starts: DataFrame, steps: DataFrame, k: int, stop: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Expand until all beams have stopped or reached the length; each round is written once.

    The state is k rows per program whatever the round, so rounds neither grow nor skew.
    """
    beams = persist_table(starts, "beam")
    for _ in range(max_length):
        beams = persist_table(expand(beams, steps, k, stop), "beam")
        if beams.where("rolling").isEmpty():
            break
    return best_candidates(beams, k, "logp", "pid", "seq")
