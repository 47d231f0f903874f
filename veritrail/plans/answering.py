"""Whole tables of questions to extractive answers with citations and an explicit outcome.

A question is screened, retrieved for, and answered with the statements of its chunks
that hold its rarest words, verbatim.  Lexical search and word weights read a chunk with
its file and heading; chunks in which screening finds an attack are never quoted.  What a statement scores is the inverse document
frequency of its words that match the question's; matches are found by equi-joins, and
only chunks that some question retrieved are split into statements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, context, dense, evidence, fusion, lexical, matching, security, selection
from ..sources.stored import stored

PEAK_FLOOR, LEAST_CHARS, FOCUSED, CLIP = 1.6, 12, 5, 320
ANSWERED, NO_CONTEXT, BLOCKED_INPUT, BLOCKED_OUTPUT, OFF_TOPIC = "answered", "no_context", "blocked_injection", "blocked_output", "off_topic"


@dataclass(frozen=True)
class Replies:
    """What is said when there is no answer."""

    refusal: str = "I can't help with that. I only answer from my knowledge base, and I don't change my instructions on request."
    no_context: str = "I don't have that information in my knowledge base."
    off_topic: str = "I can only answer questions about what my knowledge base covers."
    smalltalk: str = "Hello. Ask me something about my knowledge base."


def quotable(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The retrieved chunks in which screening finds no attack, not even a quoted one."""
    held = chunks.join(hits.select("position").distinct(), "position", "left_semi")
    return context.with_context(held).filter(~F.col("hostile")).select(chunks.columns)


def statements(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(position, n, statement, prompt, is_list_item) of the retrieved chunks that can be evidence."""
    held = quotable(hits, chunks)
    split = evidence.with_evidence_units(held.select("position", "section", "text")).select("position", "section", F.posexplode("units").alias("n", "u"))
    said = split.select("position", "section", "n", F.col("u.text").alias("statement"), F.col("u.prompt").alias("prompt"), F.col("u.is_list_item").alias("is_list_item"))
    long_enough = (F.length("statement") >= LEAST_CHARS) | F.col("is_list_item") | F.col("statement").rlike("\\p{Nd}")
    return said.filter(T.is_answerable(F.concat_ws(" ", "prompt", "statement")) & long_enough)


def scored_statements(hits: DataFrame, said: DataFrame, questions: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, rank, position, n, score, peak): sum and maximum of the weights of each statement's matching words."""
    terms = questions.select("qid", F.explode(F.array_distinct(T.content_terms(F.col("message")))).alias("term"))
    surface = said.select("position", "n", F.explode(F.array_distinct(T.content_terms(F.concat_ws(" ", "section", "prompt", "statement")))).alias("token"))
    pairs = matching.matching_pairs(terms.select("term"), surface.select(F.col("token").alias("term"))).select(F.col("a").alias("term"), F.col("b").alias("token"))
    asked = terms.join(pairs, "term").select("qid", "token").distinct().join(weights.select(F.col("term").alias("token"), "idf"), "token")
    met = hits.select("qid", "rank", "position").join(surface, "position").join(asked, ["qid", "token"])
    return met.groupBy("qid", "rank", "position", "n").agg(F.sum("idf").alias("score"), F.max("idf").alias("peak"))


def answer(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, replies: Replies = Replies(), top_k: int = dense.TOP_K, profile: classify.Profile | None = None) -> DataFrame:
    """(qid, classification, outcome, response, sources, rule_ids) for questions (qid, message, vec).

    ``chunks`` has (position, source_file, section, text).  Every question gets one row.
    With a ``profile``, questions outside its subject are told so and not searched for;
    without one every question that is no attack is in scope.
    """
    own = questions.select("qid", "message", "vec")
    if profile is None:
        judged = security.with_verdict(own, "message")
        kind = F.when(F.col("verdict.is_injection"), classify.INJECTION).otherwise(classify.IN_SCOPE)
        judged = judged.withColumns({"classification": kind, "smalltalk": F.lit(False)})
    else:
        judged = classify.classify(own, profile)
        judged = judged.withColumns({"smalltalk": F.col("classification.smalltalk"), "classification": F.col("classification.class")})
    judged = stored(judged, "judged")
    asked = judged.filter(F.col("classification") == classify.IN_SCOPE).select("qid", "message", "vec")
    indexed = chunks.withColumn("text", T.lexical_text(F.col("source_file"), F.col("section"), F.col("text")))
    found = stored(fusion.retrieve(indexed, vectors, asked, top_k=top_k), "hits")
    hits = stored(fusion.expand_siblings(found, chunks), "context")
    said = stored(statements(hits, chunks), "statements")
    weights = stored(lexical.document_frequencies(indexed.select("position", "text")), "weights")
    scored = scored_statements(hits, said, asked, weights)
    strong = selection.above_floor(scored.filter(F.col("peak") >= PEAK_FLOOR)).join(said.select("position", "n", "statement"), ["position", "n"])
    strong = stored(strong, "strong-statements")
    ordered = strong.select(
        "qid", F.struct(T.is_negative_evidence(F.col("statement")).alias("absent"), (-F.round("peak", 9)).alias("peak"), (-F.round("score", 9)).alias("score"), "position", "n").alias("rank"), "statement"
    )
    kept = selection.without_repeats(ordered, FOCUSED, weights)
    rendered = kept.select("qid", F.array_join(F.transform("kept", lambda s: T.as_sentence(T.clip(s, CLIP))), " ").alias("text"), F.explode("kept").alias("statement"))
    files = chunks.select("position", T.citation(F.col("source_file"), F.col("section")).alias("citation"))
    cited = rendered.join(strong.select("qid", "statement", "position"), ["qid", "statement"]).join(files, "position")
    answers = cited.groupBy("qid", "text").agg(F.sort_array(F.collect_set("citation")).alias("sources"))
    broken = F.size(security.violations(F.col("text"))) > 0
    blocked, outside = F.col("classification") == classify.INJECTION, F.col("classification") == classify.OFF_TOPIC
    outcome = F.when(blocked, BLOCKED_INPUT).when(outside, OFF_TOPIC).when(F.col("text").isNull(), NO_CONTEXT).when(broken, BLOCKED_OUTPUT).otherwise(ANSWERED)
    polite = F.when(F.col("smalltalk"), replies.smalltalk).otherwise(replies.off_topic)
    response = F.when(blocked, replies.refusal).when(outside, polite).otherwise(security.vetted(F.col("text"), replies.no_context))
    none = F.array().cast("array<string>")
    return judged.join(answers, "qid", "left").select(
        "qid", "classification", outcome.alias("outcome"), response.alias("response"), F.when(blocked | outside, none).otherwise(F.coalesce("sources", none)).alias("sources"),
        F.transform("verdict.matches", lambda m: m["rule_id"]).alias("rule_ids"),
    )
