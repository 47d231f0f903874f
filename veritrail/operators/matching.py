"""Term pairs that count as equal: by equi-joins, or within a row by keys of which one is in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def matching_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of distinct terms of ``left`` and ``right`` (term) that match: one variant group, or a bounded beginning.

    A longer term offers its beginnings that are at most three shorter, so the join is on
    equal strings and a term meets those alone that it matches.
    """
    a = left.select(F.col("term").alias("a")).filter("a is not null").distinct()
    b = right.select(F.col("term").alias("b")).filter("b is not null").distinct()

    def beginnings(c: str):
        cuts = F.filter(F.sequence(F.length(c) - T.MOST_LONGER, F.length(c)), lambda n: n >= T.LEAST_PREFIX)
        return F.explode(F.transform(cuts, lambda n: F.substr(F.col(c), F.lit(1), n)))

    same = a.withColumn("form", T.canonical_form(F.col("a"))).join(b.withColumn("form", T.canonical_form(F.col("b"))), "form")
    longer = a.withColumn("form", beginnings("a")).join(b.withColumn("form", F.col("b")), "form")
    shorter = a.withColumn("form", F.col("a")).join(b.withColumn("form", beginnings("b")), "form")
    return same.select("a", "b").union(longer.select("a", "b")).union(shorter.select("a", "b")).distinct()


def _shorter(word: Column) -> Column:
    """Beginnings of a word that match it and are shorter."""
    cuts = F.filter(F.sequence(F.length(word) - T.MOST_LONGER, F.length(word) - 1), lambda n: n >= T.LEAST_PREFIX)
    return F.transform(cuts, lambda n: F.substr(word, F.lit(1), n))


def asking_keys(term: Column) -> Column:
    """Keys of a term; it matches a word if one of them is among the word's ``offered_keys``."""
    longer = F.transform(_shorter(term), lambda w: F.concat(F.lit(">"), w))
    return F.concat(F.array(F.concat(F.lit("="), T.canonical_form(term)), F.concat(F.lit("<"), term)), longer)


def offered_keys(words: Column) -> Column:
    """Distinct keys of all words of an array."""
    each = F.transform(words, lambda w: F.concat(F.array(F.concat(F.lit("="), T.canonical_form(w)), F.concat(F.lit(">"), w)), F.transform(_shorter(w), lambda b: F.concat(F.lit("<"), b))))
    return F.array_distinct(F.flatten(each))
