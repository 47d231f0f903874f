"""The corpus pipeline: toxicity, language, near copies, benchmark passages, SentencePiece.

Each stage takes (spark, docs, sf_dir) and is given what its predecessor kept, written
as Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import decontaminate, language_id, near_dedup, queries, toxicity
from veritrail.llm.shared import BROADCAST_ROWS, bound_batches, stored

#: A document is dropped as toxic from this score on.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as learned from ``labels``."""
    fitted = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_toxicity(docs, fitted, output="_toxicity").filter(F.col("_toxicity") < TOXIC_FROM).select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages."""
    judged = language_id.with_language(docs, language_id.fit(docs), output="_language")
    return judged.filter(~F.col("_language.rejected")).select(docs.columns)


#: Tells rows apart within a stage.
KEY = "_row_key"


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Documents with a key of their own, and whether that is their id: rows are numbered where an id is null or repeated."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id")), True
    return stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "pipeline-rows"), False


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed documents whose key is not in ``keys`` (doc_id), without their key."""
    keys = stored(keys.select(F.col("doc_id").alias(KEY)).distinct(), "pipeline-ids")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, KEY, "left_anti").drop(KEY)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document with the smallest id, null last; an id's other texts are documents of their own."""
    rows, by_id = _keyed(docs)
    classes = stored(near_dedup.near_duplicate_classes(rows, KEY), "pipeline-classes")
    if by_id:
        return _without(rows, classes.filter("doc_id <> class_id")).select(docs.columns)
    named = classes.join(rows.select(F.col(KEY).alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("doc_id"))
    return _without(rows, classes.join(first.select("doc_id"), "doc_id", "left_anti")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    rows, _ = _keyed(docs)
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), KEY)
    return _without(rows, leaks).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's SentencePiece ids, and whether they decode to its text."""
    return queries.sentencepiece_digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_batches(stage: Stage) -> Stage:
    """A stage whose Python workers get whole texts in batches of bounded bytes."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [
    ("toxicity", _in_batches(drop_toxic)),
    ("language", _in_batches(keep_languages)),
    ("near_dedup", _in_batches(one_of_each)),
    ("decontamination", _in_batches(drop_leaks)),
    ("sentencepiece", _in_batches(pieces)),
]

#: Trained models and similarity search have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
