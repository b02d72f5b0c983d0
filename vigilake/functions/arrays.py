
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.text import strip


def ordered_distinct(values: Column) -> Column:
    """ARR-01: first occurrences, in order."""
    return F.array_distinct(values)


def sorted_distinct(values: Column) -> Column:
    """ARR-02: without blanks."""
    return F.sort_array(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def cleaned(values: Column) -> Column:
    """ARR-05: trimmed, without blanks."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: strip(x.cast("string"))), lambda x: x != "")


def term_list(preferred: Column, others: Column) -> Column:
    """ARR-06/FLT-10: the preferred term, then the others that differ from it (case ignored)."""
    return F.concat(F.array(preferred), F.filter(others, lambda x: F.lower(x) != F.lower(preferred)))


def combinations(names: Column) -> Column:
    """ARR-04: all names; for more than two, every list without one name, then every pair; the first of equal sets stays."""
    n = F.size(names)
    without = F.transform(names, lambda _, i: F.filter(names, lambda __, j: i != j))
    pairs = F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, n), lambda b: F.array(a, b))))
    every = F.concat(F.array(names), F.when(n > 2, F.concat(without, pairs)).otherwise(F.array().cast("array<array<string>>")))
    keyed = F.transform(every, lambda x: F.struct(F.array_sort(x).alias("k"), x.alias("v")))
    keys = F.transform(keyed, lambda x: x["k"])
    first = F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == (i + 1))
    return F.transform(first, lambda x: x["v"])


def pacing(hits: Column) -> Column:
    """STM-06: the wait after a run of answers; doubled (at most 8) after a refusal, else times 0.85 (at least 1)."""
    return F.aggregate(hits, F.lit(1.0), lambda a, h: F.when(h, F.least(a * 2, F.lit(8.0))).otherwise(F.greatest(a * 0.85, F.lit(1.0))))
