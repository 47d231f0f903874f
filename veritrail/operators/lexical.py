"""BM25 over chunks for whole tables of questions.

Only the questions' terms leave a document: its words are counted in place, so the
exchange carries a row for each document and asked term and never the full index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.5, 0.75
#: Lexical hits count as decisive from so many matched terms or so rare a term on.
LEAST_TERMS, RARE_IDF = 2, 2.0
#: Distinct asked terms up to which they are broadcast.
BROADCAST_TERMS = 500_000


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(position, term, tf) of every term of every chunk (position, text)."""
    return chunks.select("position", F.explode(T.tokenise(F.col("text"))).alias("term")).groupBy("position", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl); chunks without a token count in both."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(T.tokenise(F.col("text")))), F.lit(0.0)).alias("avgdl"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df, idf): chunks that hold each term; distinct terms are taken in place, before the exchange."""
    held = chunks.select(F.explode(F.array_distinct(T.tokenise(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return held.crossJoin(F.broadcast(corpus_stats(chunks).select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def search(chunks: DataFrame, questions: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, position, score, matched_terms, max_idf) of all chunks with a positive score.

    ``chunks`` has (position, text), ``questions`` (qid, message); a question's terms are
    its distinct content terms.  Null or empty messages match nothing.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(T.content_terms(F.col("message")))).alias("term"))
    terms = asked.select("term").distinct()
    small = terms.count() <= BROADCAST_TERMS
    tokens = chunks.select("position", T.tokenise(F.col("text")).alias("tokens")).select("position", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    postings = tokens.join(F.broadcast(terms) if small else terms, "term").groupBy("position", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = F.broadcast(corpus_stats(chunks))  # one row
    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(stats)
    held = held.select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    weighted = postings.join(F.broadcast(held) if small else held, "term")
    share = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = weighted.select("position", "term", "idf", share.alias("part"))
    hits = parts.join(asked, "term").groupBy("qid", "position")
    return hits.agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched_terms"), F.max("idf").alias("max_idf")).filter("score > 0")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k rows of each question, by score and then position, with their rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "position")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def decisive(hits: DataFrame) -> DataFrame:
    return hits.filter((F.col("matched_terms") >= LEAST_TERMS) | (F.col("max_idf") >= RARE_IDF))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct terms by source file."""
    return chunks.select("source_file", F.explode(F.array_distinct(T.tokenise(F.col("text")))).alias("term")).distinct()
