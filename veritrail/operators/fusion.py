"""Hybrid retrieval: admission, reciprocal rank fusion and sibling expansion for tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import dense, lexical

RRF_K, POOL_FACTOR = 60, 3
SIBLINGS, CONTEXT_CHUNKS = 12, 32


def reciprocal_ranks(dense_hits: DataFrame, lexical_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, position, similarity, lexical_score, fused) of admitted hits: sum of 1/(k + rank) over both lists.

    ``dense_hits`` has (qid, position, similarity, admitted), ``lexical_hits`` (qid,
    position, score).  A dense hit counts if it is admitted itself or by the lexical list;
    ranks are taken over what counts.
    """
    both = dense_hits.join(lexical_hits.select("qid", "position", F.col("score").alias("lexical_score")), ["qid", "position"], "full")
    both = both.filter(F.col("admitted") | F.col("lexical_score").isNotNull())
    ranked = both.withColumns(
        {
            name: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy("qid").orderBy(F.col(c).isNull(), F.desc(F.round(c, 9)), "position")))
            for name, c in (("dense_rank", "similarity"), ("lexical_rank", "lexical_score"))
        }
    )
    fused = sum(F.coalesce(1 / (k + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank"))
    return ranked.select("qid", "position", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), fused.alias("fused"))


def retrieve(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, top_k: int = dense.TOP_K, threshold: float = dense.THRESHOLD) -> DataFrame:
    """(qid, rank, position, source_file, similarity, lexical_score, fused): the best chunks of each question.

    ``chunks`` has (position, source_file, text), ``vectors`` (position, vec), ``questions``
    (qid, message, vec).
    """
    near = dense.search(vectors, questions.select("qid", "vec"), top_k)
    near = near.select("qid", "position", "similarity", (F.col("similarity") >= threshold).alias("admitted"))
    hits = reciprocal_ranks(near, decisive_words(chunks, questions, top_k)).join(chunks.select("position", "source_file"), "position")
    return _ranked(hits, top_k)


def decisive_words(chunks: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """(qid, position, score) of the lexical pool's decisive hits."""
    words = lexical.search(chunks.select("position", "text"), questions.select("qid", "message"))
    return lexical.decisive(lexical.top(words, POOL_FACTOR * top_k)).select("qid", "position", "score")


def _ranked(hits: DataFrame, top_k: int) -> DataFrame:
    best = lexical.top(hits, top_k, "fused").withColumn("rank", F.col("rank") - 1)
    return best.select("qid", "rank", "position", "source_file", "similarity", "lexical_score", "fused")


def retrieve_scoped(
    chunks: DataFrame, vectors: DataFrame, questions: DataFrame, top_k: int = dense.TOP_K, threshold: float = dense.THRESHOLD, relax_threshold: bool = False, k: int = RRF_K
) -> DataFrame:
    """As ``retrieve``, for questions that may only be answered by chunks that share one of their ``keys``.

    ``chunks`` and ``questions`` have ``keys``; a question without any finds nothing.  The
    scope comes before the cut, and after the lexical pool is cut.  Ranks still count the
    whole store, as an unscoped search would: the few chunks that can be among the best are
    found under a mask, and what comes before them is then counted, so no pair of
    question and chunk is written out.  ``relax_threshold`` admits any chunk in scope.
    """
    asked = stored(questions.filter(F.size("keys") > 0).select("qid", "message", "vec", "keys"), "scoped-questions")
    least = None if relax_threshold else threshold
    keyed = vectors.join(chunks.select("position", "keys"), "position")
    near = dense.search(keyed, asked.select("qid", "vec", "keys"), top_k, least, scoped=True).select("qid", "position", "similarity")
    words = decisive_words(chunks, asked, top_k).join(chunks.select("position", "keys"), "position").join(asked.select("qid", F.col("keys").alias("own")), "qid")
    words = stored(words.filter(F.arrays_overlap("keys", "own")).select("qid", "position", F.col("score").alias("lexical_score")), "scoped-words")
    found = near.unionByName(dense.similarities(vectors, asked, words)).groupBy("qid", "position").agg(F.max("similarity").alias("similarity"))
    both = stored(found.join(words, ["qid", "position"], "full"), "scoped-hits")
    above = dense.counted_above(vectors, asked, both, least)
    order = Window.partitionBy("qid").orderBy(F.col("similarity").isNull(), F.desc(F.round("similarity", 9)), "position")
    # lexical hits below the threshold are admitted too, and count for those after them
    under = F.lit(0) if relax_threshold else F.coalesce(F.sum(F.when(F.col("similarity") < threshold, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lexical_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("lexical_score").isNull(), F.desc(F.round("lexical_score", 9)), "position"))
    ranked = both.withColumns({"_under": under, "_lexical": lexical_rank}).join(above, ["qid", "position"], "left")
    dense_share = F.when(F.col("similarity").isNotNull(), 1 / (k + 1 + F.col("above") + F.col("_under"))).otherwise(0.0)
    lexical_share = F.when(F.col("lexical_score").isNotNull(), 1 / (k + F.col("_lexical"))).otherwise(0.0)
    zero = F.lit(0.0)
    hits = ranked.select("qid", "position", F.coalesce("similarity", zero).alias("similarity"), F.coalesce("lexical_score", zero).alias("lexical_score"), (dense_share + lexical_share).alias("fused"))
    return _ranked(hits.join(chunks.select("position", "source_file"), "position"), top_k)


def best_document_scores(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid", "source_file").agg(F.max("fused").alias("doc_score"))


def expand_siblings(hits: DataFrame, chunks: DataFrame, similarities: DataFrame | None = None, per_document: int = SIBLINGS, most: int = CONTEXT_CHUNKS) -> DataFrame:
    """``hits`` followed by further chunks of their documents, best documents first, up to ``most`` a question.

    Siblings have no fused or lexical score, and the similarity that was measured, else 0.
    A document offers its first ``per_document`` chunks by position, so the windows hold
    that many rows a document; ranking within a document keeps only those before sorting.
    """
    scores = best_document_scores(hits)
    siblings = chunks.select("position", "source_file").join(scores, "source_file")
    siblings = siblings.join(hits.select("qid", "position"), ["qid", "position"], "left_anti")
    inside = Window.partitionBy("qid", "source_file").orderBy("position")
    first = siblings.withColumn("k", F.row_number().over(inside)).filter(F.col("k") <= per_document)
    over = Window.partitionBy("qid").orderBy(F.desc(F.round("doc_score", 12)), "source_file", "position")
    held = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    placed = first.withColumn("n", F.row_number().over(over)).join(held, "qid").filter(F.col("n") <= most - F.col("n_hits"))
    measured = placed if similarities is not None else placed.withColumn("similarity", F.lit(0.0))
    if similarities is not None:
        measured = placed.join(similarities.select("qid", "position", "similarity"), ["qid", "position"], "left")
    zero = F.lit(0.0)
    more = measured.select(
        "qid", (F.col("n_hits") + F.col("n") - 1).cast("int").alias("rank"), "position", "source_file", F.coalesce("similarity", zero).alias("similarity"), zero.alias("lexical_score"), zero.alias("fused")
    )
    return hits.select(more.columns).unionByName(more)
