"""Choice among scored statements of a question: relative cut, greedy removal of near-repeats, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCORE_FLOOR, SAME_SHARE, OVERLAP, OVERLAP_TERMS = 0.55, 0.5, 0.6, 3
#: Terms below this inverse document frequency do not show that one statement restates another.
RARE = 1.6


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; two empty ones share nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def restates(a: Column, b: Column) -> Column:
    """Whether most of the shorter of two term lists is matched in the longer; both need three terms."""
    shorter, longer = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    matched = F.size(F.filter(shorter, lambda t: T.terms_match(t, longer)))
    return (F.least(F.size(a), F.size(b)) >= OVERLAP_TERMS) & (matched >= OVERLAP * F.size(shorter))


def above_floor(scored: DataFrame, peak: str = "peak", floor: float = SCORE_FLOOR) -> DataFrame:
    """Rows whose peak is at least a share of the best of their question."""
    best = scored.groupBy("qid").agg(F.max(peak).alias("_best"))
    return scored.join(best, "qid").filter(F.col(peak) >= floor * F.col("_best")).drop("_best")


def without_repeats(statements: DataFrame, most: int, weights: DataFrame | None = None, least_idf: float = RARE) -> DataFrame:
    """(qid, kept): the first ``most`` statements (qid, rank, statement) that repeat none kept before.

    Repeats are equal keys, half of the terms shared, or a restatement.  With ``weights``
    (term, idf) a restatement is judged by terms from ``least_idf`` on alone, as common
    words say nothing.  Equal keys are aggregated first, since they have equal terms; the
    fold goes through all that remain.
    """
    keyed = statements.select("qid", T.normalise_key(F.col("statement")).alias("key"), F.struct("rank", F.col("statement").alias("s")).alias("x"))
    first = keyed.groupBy("qid", "key").agg(F.min("x").alias("x")).withColumn("terms", F.array_distinct(T.content_terms(F.col("x.s"))))
    first = first.withColumn("rare", F.col("terms"))
    if weights is not None:
        known = weights.filter(F.col("idf") >= least_idf).select("term")
        rare = first.select("qid", "key", F.explode("terms").alias("term")).join(known, "term", "left_semi").groupBy("qid", "key").agg(F.collect_set("term").alias("rare"))
        first = first.drop("rare").join(rare, ["qid", "key"], "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    ready = first.select("qid", F.struct("x.rank", "x.s", "terms", "rare").alias("x"))
    kind = "array<struct<s:string,terms:array<string>,rare:array<string>>>"

    def add(kept: Column, x: Column) -> Column:
        repeats = F.exists(kept, lambda y: (jaccard(x["terms"], y["terms"]) >= SAME_SHARE) | restates(x["rare"], y["rare"]))
        return F.when((F.size(kept) >= most) | repeats, kept).otherwise(F.concat(kept, F.array(x)))

    grouped = ready.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    ordered = F.transform("xs", lambda x: F.struct(x["s"].alias("s"), x["terms"].alias("terms"), x["rare"].alias("rare")))
    return grouped.select("qid", F.transform(F.aggregate(ordered, F.array().cast(kind), add), lambda x: x["s"]).alias("kept"))
