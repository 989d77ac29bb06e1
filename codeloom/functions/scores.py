"""Set similarity, rates and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LENGTH_POWER = 0.7
PAD_SCORE = -20000.0


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; two empty sets are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(tokens: Column, n: int) -> Column:
    count = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def rate(passed: Column, failed: Column) -> Column:
    return passed / (passed + failed + 0.001) * 100.0


def rates_with_blanks(passed: Column, blank: Column, failed: Column) -> tuple[Column, Column, Column]:
    """Percentage passed, percentage blank, and percentage passed without the blanks."""
    return rate(passed, failed), blank / (passed + failed + 0.001) * 100.0, rate(passed - blank, failed)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: x - top - F.ln(total))


def top_scores(values: Column, k: int) -> tuple[Column, Column]:
    """Best k log-scores and their indexes, padded with a very low score and index 1."""
    pairs = F.transform(log_softmax(values), lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
    best = F.slice(F.array_sort(pairs), 1, k)
    scores = F.transform(best, lambda p: -p["neg"])
    indexes = F.transform(best, lambda p: p["i"])
    return (
        F.slice(F.concat(scores, F.array_repeat(F.lit(PAD_SCORE), k)), 1, k),
        F.slice(F.concat(indexes, F.array_repeat(F.lit(1), k)), 1, k),
    )


def length_normalised(step: Column, old: Column, length: Column, grew: Column) -> Column:
    return (step + old * F.pow(length, F.lit(LENGTH_POWER))) / F.pow(length + grew, F.lit(LENGTH_POWER))


def fuse(evidences: list[Column], sigmas: list[float]) -> tuple[Column, Column]:
    """Precision-weighted mean of evidence vectors against a unit prior; absent (all-zero) ones do not count."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    present = [F.when(total(v) != 0, F.lit(1.0 / s**2)).otherwise(0.0) for v, s in zip(evidences, sigmas)]
    denom = F.lit(1.0)
    for p in present:
        denom = denom + p
    def scaled(vector: Column, weight: Column) -> Column:
        return F.transform(vector, lambda x: x * weight)

    weighted = [scaled(v, p) for v, p in zip(evidences, present)]
    summed = weighted[0]
    for v in weighted[1:]:
        summed = F.zip_with(summed, v, lambda a, b: a + b)
    return F.transform(summed, lambda x: x / denom), 1.0 / denom


def drop_masked(values: Column, seed: int, row_id: Column, rate_dropped: float) -> Column:
    """Zero each value whose seeded random number does not exceed ``rate_dropped``."""
    def number(i):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), i.cast("string")))
        return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(16**8))

    return F.transform(values, lambda v, i: F.when(number(i) > rate_dropped, v).otherwise(0.0))
