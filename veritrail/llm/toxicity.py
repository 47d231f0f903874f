"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary text, share their low-order backoff
counts, so an expression which neither class has seen often scores alike under both.  A
document is judged by its length-normalised log-likelihood ratio and by how densely its
words' own ratios pass fixed marks; a logistic regression turns these into a score.  Its
ridge pulls towards the evidence for the rarer class, which decides where few labelled
documents fit it.

Defined results: a null or empty text has no words and scores 0; rows with a null id or
label teach nothing; a document labelled twice counts by its higher label, and repeated
document rows are each scored; without any labelled row every score is 0; a column named
like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .shared import BROADCAST_ROWS, stored

#: Word log-likelihood ratios whose density is measured.
MARKS = (1.5, 2.5, 3.5)
EXCESS = (1.0, 2.0, 3.0)
#: At most so many labelled documents fit the logistic regression; the language models count all others.
CALIBRATION_ROWS = 20_000
RIDGE = 3.0
#: Features, and the places of the mass past the middle mark for the upper and the lower class.
WIDTH = 2 * len(MARKS) + len(EXCESS) + 4
UPPER, LOWER = 2 * len(MARKS) + 1, WIDTH - 1
_NO_EXCESS = np.log(0.005)


@dataclass
class ToxicityModel:
    model: kn.Model | None
    low: np.ndarray  # the range of each feature in calibration, to which others are clipped
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = np.c_[(np.clip(x, self.low, self.high) - self.mean) / self.scale, np.ones(len(x))]
        return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30))), 0.0)


def features(scorer: kn.DocumentScorer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """By row: densities of words past the marks on either side, mass past them, mean ratio and length; and the words."""
    seg, codes, table = scorer.words(column)
    rows, n = seg.rows, len(column)
    count = seg.per_row.astype(float)
    ratio = (table[:, 1] - table[:, 0])[codes].astype(float)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values, n) if len(rows) else np.zeros(n)

    out = []
    for mark in MARKS:
        out.append(np.log((total(ratio > mark) + 0.5) / (count + 30)))
        out.append(np.log((total(ratio < 1 - mark) + 0.5) / (count + 30)))
    for mark in EXCESS:
        out.append(np.log(total(np.maximum(ratio - mark, 0)) / (count + 20) + 0.005))
    characters = total(table[codes, 2].astype(float))
    out.append(total(ratio) / np.maximum(characters, 1))
    out.append(total(np.clip(ratio, -1, 6)) / np.maximum(count, 1))
    out.append(np.log(np.maximum(count, 1)))
    out.append(np.log(total(np.maximum(-ratio - EXCESS[1], 0)) / (count + 20) + 0.005))
    return np.stack(out, 1), seg.per_row


def prior(share: float) -> np.ndarray:
    """Weights before any row is seen, with the intercept last: of evidence for either class, the more the rarer it is."""
    w = np.zeros(WIDTH + 1)
    w[UPPER], w[LOWER], w[-1] = 1 - share, -share, np.log((share + 1e-6) / (1 - share + 1e-6))
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps with a ridge towards ``prior``: means, scales and weights with the intercept last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = prior.copy()
    towards = np.r_[prior[:-1], 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + RIDGE * np.eye(len(w)), z.T @ (p - y) + RIDGE * (w - towards))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fold(doc_id: Column) -> Column:
    """The crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string"))


def fit(docs: DataFrame, labels: DataFrame, order: int = 5, shared: int = 3, hash_bits: int = 64, calibration_rows: int = CALIBRATION_ROWS) -> ToxicityModel | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without ids whose crc32 mod 4 is 2.

    Of a fifth of the labelled documents by hash the first ``calibration_rows`` fit the
    regression; all others are counted, and those too where neither part has both classes.
    The labels are broadcast only while they have at most ``BROADCAST_ROWS`` rows; beyond that Spark shuffles the join.
    """
    crc = fold(F.col("doc_id"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("cls")).dropna()
    known = known.filter(crc % 4 != 2).groupBy("doc_id").agg(F.max("cls").alias("cls"))
    known = stored(known.withColumn("fifth", F.floor(crc / 4) % 5 == 0), "toxicity-labels")
    sample = stored(known.filter("fifth").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows), "toxicity-sample")
    texts = docs.select("doc_id", kn.normal_words(F.col("text")).alias("norm"))

    def labelled(part: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(part) if part.count() <= BROADCAST_ROWS else part, "doc_id")

    if known.isEmpty():
        return None
    counted = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")  # at most calibration_rows
    n, drawn = ({r["cls"]: r["count"] for r in part.groupBy("cls").count().collect()} for part in (counted, sample))
    if len(n) < 2 and len(drawn) < 2:
        counted, sample = known, sample.limit(0)
    counts = stored(kn.word_counts(labelled(counted)), "toxicity-words")
    model = kn.train(counts, order, hash_bits, 2, shared)
    shared_model = kn.shared_model(docs.sparkSession, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kn.by_slices(batch.column("norm"), lambda c: features(kn.scorer(shared_model.value), c)[0])
            yield pa.record_batch([batch.column("cls"), pa.array(list(x), pa.list_(pa.float64()))], names=["cls", "x"])

    rows = labelled(sample).select("cls", "norm").mapInArrow(measure, "cls int, x array<double>").toArrow()
    expected = prior((n.get(1, 0) + drawn.get(1, 0)) / (sum(n.values()) + sum(drawn.values())))
    if len(rows.column("cls").unique()) < 2:
        mean = np.zeros(WIDTH)
        mean[[UPPER, LOWER]] = _NO_EXCESS
        return ToxicityModel(model, np.full(WIDTH, -np.inf), np.full(WIDTH, np.inf), mean, np.ones(WIDTH), expected)
    order_ = np.lexsort(np.stack(rows.column("x").to_pylist()).T)  # sums of floats, in an order that the rows fix
    x = np.stack(rows.column("x").to_pylist())[order_]
    return ToxicityModel(model, x.min(0), x.max(0), *fit_logistic(x, np.asarray(rows.column("cls"))[order_].astype(float), expected))


def with_toxicity(df: DataFrame, fitted: ToxicityModel | None, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Add the probability that each whole text is toxic."""
    if fitted is None:
        return df.withColumn(output, F.lit(0.0))
    held, light = kn.shared_model(df.sparkSession, fitted.model), replace(fitted, model=None)

    @F.arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        return pa.array(kn.by_slices(column, lambda c: light.score(*features(kn.scorer(held.value), c))))

    return df.withColumn(output, judge(kn.normal_words(F.col(text))))
