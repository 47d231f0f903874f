"""Replies as JSON, JSON back to replies, and what a reader is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a reply may be called, and the state that it puts a reader's view into.
CLASSES = ("injection", "in_scope", "off_topic")
STATES = {"answered": "answered", "no_context": "no_context", "off_topic": "off_topic", "blocked_injection": "blocked", "blocked_output": "blocked"}
#: Details that no reader is shown.
INTERNAL = (r"\.md\b", r"[\\]", r"(?i)\bfaiss\b", r"(?i)\bbm25\b", r"chunk[_ -]?id", r"0\.\d{3,}", r"(?i)<<<|\[INST\]|<\|im_")
SOURCES = "array<struct<source_file:string,section:string,similarity:double>>"


def response_json(replies: DataFrame) -> DataFrame:
    """(qid, body): replies (qid, response, classification, outcome, sources, retrieval_scores, rule_ids) as JSON objects."""
    fields = [F.col(c) for c in ("response", "classification", "outcome", "sources", "retrieval_scores")]
    return replies.select("qid", F.to_json(F.struct(*fields, F.lit(False).alias("llm_used"), F.col("rule_ids").alias("injection_rule_ids"))).alias("body"))


def _text_at(body: Column, path: str) -> Column:
    """A string in a JSON value; null if there is none or it is something else."""
    return F.when(F.schema_of_variant(F.variant_get(body, path, "variant")) == "STRING", F.try_variant_get(body, path, "string"))


def with_parsed(df: DataFrame, body: str = "body", output: str = "parsed") -> DataFrame:
    """Add a struct (response, classification, outcome, state, sources, scores) of a JSON reply; null if it is malformed.

    A reply needs a text that is not blank and a known class and outcome; its sources, if
    given, are a list.  A source that is no object or has no file is left out alone.
    """
    read = df.withColumn("_v", F.try_parse_json(F.col(body)))
    v = F.col("_v")
    kind = F.schema_of_variant(F.variant_get(v, "$.sources", "variant"))
    sources_ok = F.coalesce(kind == "VOID", F.lit(True)) | F.startswith(kind, F.lit("ARRAY"))
    response, outcome, named = _text_at(v, "$.response"), _text_at(v, "$.outcome"), _text_at(v, "$.classification")
    entries = F.coalesce(F.try_variant_get(v, "$.sources", "array<variant>"), F.array().cast("array<variant>"))
    found = F.filter(entries, lambda s: F.coalesce(_text_at(s, "$.source_file"), F.lit("")) != "")
    number = lambda s: F.coalesce(F.when(~F.schema_of_variant(F.variant_get(s, "$.similarity", "variant")).isin("STRING", "BOOLEAN"), F.try_variant_get(s, "$.similarity", "double")), F.lit(0.0))
    sources = F.transform(found, lambda s: F.struct(_text_at(s, "$.source_file").alias("source_file"), F.coalesce(_text_at(s, "$.section"), F.lit("")).alias("section"), number(s).alias("similarity")))
    valid = (T.stripped(response) != "") & outcome.isin(*STATES) & named.isin(*CLASSES) & sources_ok
    state = F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), outcome)
    scores = F.coalesce(F.try_variant_get(v, "$.retrieval_scores", "array<double>"), F.array().cast("array<double>"))
    parsed = F.struct(response.alias("response"), named.alias("classification"), outcome.alias("outcome"), state.alias("state"), sources.cast(SOURCES).alias("sources"), scores.alias("scores"))
    return read.withColumn(output, F.when(F.coalesce(valid, F.lit(False)), parsed)).drop("_v")


#: Why a request is refused.
MALFORMED, BLANK, TOO_LONG = "malformed", "blank", "too_long"


def with_request(df: DataFrame, most: int, body: str = "body") -> DataFrame:
    """Add ``message`` and ``error`` of a JSON request: its message, or why there is none; other fields of a request are an error."""
    read = df.withColumn("_v", F.try_parse_json(F.col(body)))
    said = _text_at(F.col("_v"), "$.message")
    extra = F.coalesce(F.size(F.json_object_keys(F.col(body))), F.lit(0)) > 1
    error = F.when(said.isNull() | extra, MALFORMED).when(T.stripped(said) == "", BLANK).when(F.length(said) > most, TOO_LONG)
    return read.withColumns({"error": error, "message": F.when(error.isNull(), said)}).drop("_v")


def split_statements(response: Column) -> Column:
    """The bullets of a reply without their marks, or all of it if it has none."""
    lines = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), "\n", -1), T.stripped), lambda x: x != "")
    bullets = F.filter(lines, lambda x: F.startswith(x, F.lit("- ")))
    whole = F.filter(F.array(T.stripped(F.coalesce(response, F.lit("")))), lambda x: x != "")
    return F.when(F.size(bullets) > 0, F.filter(F.transform(bullets, lambda x: T.stripped(F.substring(x, 3, 1 << 30))), lambda x: x != "")).otherwise(whole)


def section_label(section: Column, document: Column) -> Column:
    """The last part of a heading path; empty where that is the document's own name."""
    tail = T.stripped(F.element_at(F.split(T.stripped(F.coalesce(section, F.lit(""))), ">", -1), -1))
    return F.when(F.lower(tail) == F.lower(document), "").otherwise(tail)


def display_sources(replies: DataFrame, files: DataFrame, fallback: str = "Document") -> DataFrame:
    """(qid, shown): distinct (document, section) of each reply's sources in order; files (source_file, title) name documents."""
    each = replies.select("qid", F.posexplode("sources").alias("n", "s")).select("qid", "n", F.col("s.source_file").alias("source_file"), F.col("s.section").alias("section"))
    named = each.join(files.select("source_file", "title"), "source_file", "left").withColumn("document", F.coalesce("title", F.lit(fallback)))
    row = F.struct("n", F.struct("document", section_label(F.col("section"), F.col("document")).alias("section")).alias("d"))
    shown = named.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return shown.select("qid", F.array_distinct(F.transform("_rows", lambda r: r["d"])).alias("shown"))


def has_internal_detail(text: Column) -> Column:
    out = F.lit(False)
    for pattern in INTERNAL:
        out = out | text.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def health(chunks: DataFrame, vectors: DataFrame, app: str, model: str, threshold: float) -> DataFrame:
    """One row on the index: its size, width and documents, the model and the threshold."""
    index = vectors.agg(F.count(F.lit(1)).alias("index_size"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("index_dimension"))
    documents = chunks.agg(F.count_distinct("source_file").alias("knowledge_base_documents"))
    fixed = {"status": F.lit("ok"), "app": F.lit(app), "answerer": F.lit("deterministic-extractive"), "embedding_model": F.lit(model), "similarity_threshold": F.lit(float(threshold))}
    return index.crossJoin(F.broadcast(documents)).withColumns(fixed)  # one row each
