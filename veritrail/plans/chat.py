"""Whole tables of messages to grounded replies: screening, routing, scoped retrieval, composing, vetting, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, dense, fusion, gates, lexical, profile, security
from ..sources.stored import stored
from . import composing
from .answering import ANSWERED, BLOCKED_INPUT, BLOCKED_OUTPUT, NO_CONTEXT, OFF_TOPIC, Replies

SOURCE = "array<struct<position:bigint,source_file:string,section:string,similarity:double>>"


def misses_owner(subjects: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, found, owned): whether a question has hits at all, and one of a file that owns its answer (true where no file does)."""
    keys = hits.select("qid", "position").join(chunks.select("position", "keys"), "position", "left")
    met = keys.join(subjects.select("qid", profile.contributing_keys().alias("_own")), "qid")
    seen = met.groupBy("qid").agg(F.lit(True).alias("found"), F.max(F.coalesce(F.arrays_overlap("keys", "_own"), F.lit(False))).alias("owned"))
    rows = subjects.select("qid", "owners").join(seen, "qid", "left")
    return rows.select("qid", F.coalesce("found", F.lit(False)).alias("found"), (~F.col("owners") | F.coalesce("owned", F.lit(False))).alias("owned"))


def searches_again(subjects: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions that search their files again: nothing of what owns the answer was found, and no word can reach it."""
    termless = F.size(T.content_terms(F.col("message"))) == 0
    missed = subjects.join(misses_owner(subjects, hits, chunks), "qid")
    return missed.filter((~F.col("found") | ~F.col("owned")) & (termless | ~F.col("lexical_support")) & F.col("documents"))


def used_sources(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """(qid, sources): the hits (qid, rank, position, source_file, section, similarity) that a reply cites, in rank order; all where none can be matched."""
    met = hits.join(citations.select("qid", "citations"), "qid")
    cited = F.array_contains("citations", T.citation(F.col("source_file"), F.col("section")))
    source = F.struct("rank", "position", "source_file", "section", "similarity")
    listed = met.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(cited, source))).alias("_cited"), F.sort_array(F.collect_list(source)).alias("_all"))
    used = F.when(F.size("_cited") > 0, F.col("_cited")).otherwise(F.col("_all"))
    fields = ("position", "source_file", "section", "similarity")
    return listed.select("qid", F.transform(used, lambda s: F.struct(*(s[c].alias(c) for c in fields))).cast(SOURCE).alias("sources"))


def retrieve_routed(subjects: DataFrame, chunks: DataFrame, vectors: DataFrame, top_k: int = dense.TOP_K) -> DataFrame:
    """Hits of routed questions (with support) among chunks with ``keys``.

    Questions for whole documents search those alone.  Where that finds nothing, or
    nothing of the files that own the answer, a question that the vocabulary cannot reach
    searches its files again without a threshold.
    """
    indexed = chunks.withColumn("text", T.lexical_text(F.col("source_file"), F.col("section"), F.col("text")))
    scoped = subjects.select("qid", "message", "vec", profile.scope_keys().alias("keys"))
    first = fusion.retrieve(indexed, vectors, scoped.filter("keys is null"), top_k).unionByName(fusion.retrieve_scoped(indexed, vectors, scoped.filter("keys is not null"), top_k))
    first = stored(fusion.expand_siblings(stored(first, "first-hits"), chunks), "first-context")
    again = searches_again(subjects, first, chunks).select("qid", "message", "vec", profile.allowed_keys().alias("keys"))
    again = stored(again, "fallback-questions")
    second = stored(fusion.retrieve_scoped(indexed, vectors, again, top_k, relax_threshold=True), "fallback-hits")
    second = stored(fusion.expand_siblings(second, chunks), "fallback-context")
    return first.join(second.select("qid").distinct(), "qid", "left_anti").unionByName(second)


def chat(
    questions: DataFrame, chunks: DataFrame, files: DataFrame, vectors: DataFrame, subject: classify.Profile = classify.Profile(), replies: Replies = Replies(), top_k: int = dense.TOP_K
) -> DataFrame:
    """(qid, classification, outcome, response, sources, retrieval_scores, rule_ids, declined, mode) for every question.

    ``questions`` has (qid, message, vec), ``chunks`` (position, source_file, section, text),
    ``files`` (source_file, category, title), ``vectors`` (position, vec).  Sources are the
    chunks that the reply cites, in order of retrieval, all retrieved ones where none can
    be matched; scores stand in their order.  Steps end in stored tables, so none stays cached.
    """
    judged = classify.classify(questions.select("qid", "message", "vec"), subject)
    judged = judged.select("qid", "message", "vec", F.col("classification.class").alias("classification"), F.col("classification.smalltalk").alias("smalltalk"), F.transform("verdict.matches", lambda m: m["rule_id"]).alias("rule_ids"))
    judged, files = stored(judged, "judged-questions"), stored(files, "corpus-profile")
    asked = judged.filter(F.col("classification") == classify.IN_SCOPE).select("qid", "message", "vec")
    keyed = profile.with_keys(chunks, files)
    every = chunks.join(keyed.select("position", "keys"), "position", "left")
    indexed = every.select("position", "keys", T.lexical_text(F.col("source_file"), F.col("section"), F.col("text")).alias("text"))
    routed = stored(profile.with_subject(asked, files, subject.names), "routed-questions")
    supported = stored(gates.with_support(routed, indexed, files, subject.names), "supported-questions")
    hits = stored(retrieve_routed(supported, every, vectors, top_k), "context")
    held = chunks.join(hits.select("position").distinct(), "position", "left_semi")
    composed = composing.compose(supported, hits, stored(composing.described(held, files), "described-chunks"), lexical.document_frequencies(indexed), subject.names[0] if subject.names else None)
    composed = stored(composed, "composed")
    listed = used_sources(hits.join(chunks.select("position", "section"), "position"), composed.filter("response is not null"))
    rows = judged.join(composed, "qid", "left").join(listed, "qid", "left")
    return rows.select(*_reply(replies))


def _reply(replies: Replies) -> list[Column]:
    blocked, outside = F.col("classification") == classify.INJECTION, F.col("classification") == classify.OFF_TOPIC
    broken = F.size(security.violations(F.col("response"))) > 0
    outcome = F.when(blocked, BLOCKED_INPUT).when(outside, OFF_TOPIC).when(F.col("response").isNull(), NO_CONTEXT).when(broken, BLOCKED_OUTPUT).otherwise(ANSWERED)
    polite = F.when(F.col("smalltalk"), replies.smalltalk).otherwise(replies.off_topic)
    said = F.when(blocked, replies.refusal).when(outside, polite).otherwise(security.vetted(F.col("response"), replies.no_context))
    sources = F.coalesce("sources", F.array().cast(SOURCE))
    return [
        F.col("qid"), F.col("classification"), outcome.alias("outcome"), said.alias("response"), sources.alias("sources"),
        F.transform(sources, lambda s: s["similarity"]).alias("retrieval_scores"), F.col("rule_ids"), F.col("declined"), F.col("mode"),
    ]
