"""Whether replies say only what their sources say, and whether cases came out as expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .answering import ANSWERED, BLOCKED_INPUT, NO_CONTEXT

#: Marks of emphasis and code, bullets, ends of sentences, verbs before which a subject's name may have been put.
MARKS, BULLET = r"\*{1,3}|_{1,3}|`+", r"(?mdU)^\s*(?:[-*+]|\d{1,3}[.)])\s+"
SENTENCE_END = r"(?U)(?<![A-Z])[.!?](?=\s|$)|(?<=\b[A-Z])\.(?=\s+[A-Z])"
RESTATED = "is was has had does did studies works focuses describes uses built".split()


def plain(text: Column) -> Column:
    """Lower-case words with single spaces, without marks and bullets; null is empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, ""), BULLET, "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def evidence_statements(response: Column) -> Column:
    """What a reply asserts: each bullet, and each sentence of its other lines."""

    def of_line(line: Column) -> Column:
        return F.when(F.startswith(line, F.lit("- ")), F.array(F.substring(line, 3, 1 << 30))).otherwise(F.split(line, SENTENCE_END, -1))

    lines = F.transform(F.split(F.coalesce(response, F.lit("")), r"\R|[\x1c-\x1e]", -1), T.stripped)
    return F.filter(F.transform(F.flatten(F.transform(lines, of_line)), T.stripped), lambda s: s != "")


def without_subject(statement: Column, names: tuple[str, ...]) -> Column:
    """A plain statement without the subject's name where a verb follows it."""
    if not names:
        return statement
    return F.regexp_replace(statement, rf"^(?:{'|'.join(' '.join(n.lower().split()) for n in names)})\s+(?={'|'.join(RESTATED)})", "")


def grounded_statements(replies: DataFrame, files: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(qid, statement, grounded) for replies (qid, response, cited) and files (source_file, text).

    A statement is grounded if its plain form is part of a cited file's, as it stands or
    without the subject's name in front.  Equal statements about a file are looked for
    once, and a file's text meets only statements that cite it.
    """
    said = replies.select("qid", "cited", F.explode(evidence_statements(F.col("response"))).alias("statement")).withColumn("_plain", plain(F.col("statement")))
    wanted = said.select("_plain", F.explode("cited").alias("source_file")).distinct()
    held = files.select("source_file", plain(F.col("text")).alias("_held"))
    rest = without_subject(F.col("_plain"), names)
    inside = F.contains("_held", F.col("_plain")) | ((rest != "") & F.contains(F.col("_held"), rest))
    found = wanted.filter("_plain <> ''").join(held, "source_file").filter(inside).select("_plain", "source_file").withColumn("_hit", F.lit(True))
    pairs = said.withColumn("source_file", F.explode_outer("cited")).join(found, ["_plain", "source_file"], "left")
    return pairs.groupBy("qid", "statement", "_plain").agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_hit")).select("qid", "statement", (F.col("_hit") | (F.col("_plain") == "")).alias("grounded"))


def evaluated_cases(cases: DataFrame, replies: DataFrame, files: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(qid, outcome, source_total, source_hits, statements, violations, failures) for every case.

    ``cases`` has (qid, classification, outcome, must_cite, any_cite, may_cite, contains,
    excludes), ``replies`` (qid, classification, outcome, response, cited).  Only answers
    are checked for grounding.
    """
    answered = replies.filter(F.col("outcome") == ANSWERED)
    checks = grounded_statements(answered, files, names).groupBy("qid").agg(F.count(F.lit(1)).alias("statements"), F.count_if(~F.col("grounded")).alias("violations"))
    got = replies.select("qid", F.col("classification").alias("_class"), F.col("outcome").alias("_outcome"), "response", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))
    rows = cases.join(got, "qid", "left").join(checks, "qid", "left").fillna(0, ["statements", "violations"])
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("must_cite", "any_cite", "may_cite", "contains", "excludes", "cited")}
    rows = rows.withColumns(lists)
    some_any, some_may = F.size("any_cite") > 0, F.size("may_cite") > 0
    missing = F.array_except("must_cite", "cited")
    any_ok, may_ok = F.arrays_overlap("any_cite", "cited"), F.size(F.array_except("cited", "may_cite")) == 0
    total = F.size("must_cite") + some_any.cast("int") + some_may.cast("int")
    hits = F.size("must_cite") - F.size(F.filter("must_cite", lambda m: ~F.array_contains("cited", m))) + (some_any & any_ok).cast("int") + (some_may & may_ok).cast("int")
    lacking = F.filter("contains", lambda n: ~F.coalesce(F.contains(F.col("response"), n), F.lit(False)))
    leaking = F.filter("excludes", lambda n: F.coalesce(F.contains(F.col("response"), n), F.lit(False)))
    failures = F.array_compact(
        F.concat(
            F.array(F.when(~F.col("_class").eqNullSafe(F.col("classification")), "classification"), F.when(~F.col("_outcome").eqNullSafe(F.col("outcome")), "outcome"), F.when(some_any & ~any_ok, "any_cite"), F.when(some_may & ~may_ok, "may_cite"), F.when(F.col("violations") > 0, "ungrounded")),
            F.transform(missing, lambda m: F.concat(F.lit("missing source "), m)), F.transform(lacking, lambda n: F.concat(F.lit("lacks "), n)), F.transform(leaking, lambda n: F.concat(F.lit("has "), n)),
        )
    )
    return rows.select("qid", F.col("_outcome").alias("outcome"), total.cast("long").alias("source_total"), hits.cast("long").alias("source_hits"), "statements", "violations", "cited", failures.alias("failures"))


def report(evaluated: DataFrame) -> DataFrame:
    """One row of counts over evaluated cases; source accuracy is 1 where no source was expected."""
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("source_total", "source_hits", "statements", "violations")}
    documents = evaluated.select(F.explode("cited").alias("f")).agg(F.count_distinct("f").alias("documents"))
    known = [ANSWERED, NO_CONTEXT, BLOCKED_INPUT]
    counts = evaluated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("failures") == 0).alias("passed"), F.count_if(F.col("outcome") == ANSWERED).alias("answered"), F.count_if(F.col("outcome") == NO_CONTEXT).alias("declined"),
        F.count_if(F.col("outcome") == BLOCKED_INPUT).alias("blocked"), F.count_if(~F.col("outcome").isin(known)).alias("refused"), *(c.cast("long").alias(n) for n, c in sums.items()),
    )
    accuracy = F.when(F.col("source_total") == 0, 1.0).otherwise(F.col("source_hits") / F.col("source_total"))
    return counts.withColumn("source_accuracy", accuracy).crossJoin(F.broadcast(documents))  # one row each
