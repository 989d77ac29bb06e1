"""Sets and lists inside a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def combinations(lists: list[Column]) -> Column:
    """Every way to take one element of each list, in order."""
    out = F.transform(lists[0], lambda x: F.array(x))
    for more in lists[1:]:
        out = _extend(out, more)
    return out


def _extend(heads: Column, more: Column) -> Column:
    return F.flatten(F.transform(heads, lambda head: F.transform(more, lambda x: F.concat(head, F.array(x)))))


def without_empty(paths: Column) -> Column:
    return F.filter(paths, lambda p: F.size(p) > 0)


def distinct_union(*sets: Column) -> Column:
    return F.array_distinct(F.concat(*sets))


def first_k(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def pack_left(values: Column, keep) -> Column:
    """Chosen elements first, zeros after, same length."""
    chosen = F.filter(values, keep)
    return F.slice(F.concat(chosen, F.array_repeat(F.lit(0), F.size(values))), F.lit(1), F.size(values))


def where_valid(vectors: Column) -> Column:
    """Vectors whose sum is not positive become zeros."""
    def keep(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return F.transform(v, lambda x: F.when(total > 0, x).otherwise(0))

    return F.transform(vectors, keep)
