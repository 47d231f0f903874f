"""Texts to vectors: a model behind an Arrow interface, masked mean pooling, checks of what it gives."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Texts that a model encodes at once.
BATCH = 64
LEAST_COUNT = 1e-9


class Encoder(Protocol):
    """What a model offers; it is shipped to executors, so it loads its weights when it first encodes."""

    model_name: str
    dimension: int

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token vectors (texts, tokens, dimension) and the mask of tokens that count (texts, tokens)."""


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token vectors that count; zero where none does."""
    weights = np.asarray(mask, np.float64)[..., None]
    return (np.asarray(tokens, np.float64) * weights).sum(axis=1) / np.clip(weights.sum(axis=1), LEAST_COUNT, None)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, with NaN and infinite components as 0; zero rows stay zero."""
    clean = np.nan_to_num(matrix, nan=0.0, posinf=0.0, neginf=0.0)
    norms = np.linalg.norm(clean, axis=1, keepdims=True)
    return clean / np.where(norms > 0, norms, 1.0)


def mean_pooled(tokens: Column, mask: Column, dimension: int) -> Column:
    """``mean_pool`` for an array of token vectors and an array of 0 and 1, as an expression."""
    zero = F.array_repeat(F.lit(0.0), dimension)
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(weighted, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(LEAST_COUNT))
    return T.let(count, lambda n: F.transform(total, lambda x: x / n))


def with_embeddings(df: DataFrame, encoder: Encoder, text: str = "text", output: str = "vec") -> DataFrame:
    """Add unit vectors of texts; zero, NaN and infinite components are 0, and a null text is empty.

    A model that gives other rows or another width than it says fails the task.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            parts = []
            for k in range(0, len(texts), BATCH):
                some = texts[k : k + BATCH]
                pooled = mean_pool(*encoder.encode(some))
                if pooled.shape != (len(some), encoder.dimension):
                    raise ValueError(f"{encoder.model_name} gave vectors of shape {pooled.shape} for {len(some)} texts of dimension {encoder.dimension}")
                parts.append(pooled)
            yield pa.array([row for part in parts for row in unit_rows(part)], pa.list_(pa.float64()))

    return df.withColumn(output, embed(F.col(text)))


def embedded_chunks(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """(position, vec) of chunks (position, section, text): each is embedded with its heading path above its text."""
    whole = chunks.select("position", T.embedding_text(F.col("section"), F.col("text")).alias("_text"))
    return with_embeddings(whole, encoder, "_text").select("position", "vec")


def embedded_questions(questions: DataFrame, encoder: Encoder) -> DataFrame:
    """Questions (qid, message, ...) with ``vec``; an empty message has the zero vector, which is near nothing."""
    return with_embeddings(questions, encoder, "message").withColumn("vec", F.when(F.trim(F.coalesce("message", F.lit(""))) == "", F.array_repeat(F.lit(0.0), encoder.dimension)).otherwise(F.col("vec")))
