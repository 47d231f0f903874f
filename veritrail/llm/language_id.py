"""Language identification by interpolated Kneser-Ney character models, one a language.

The language with the lowest cross-entropy a character wins.  A text is rejected if its
cross-entropy is further from its language's mean than a level chosen on training texts
that were kept out of the counts: between their own distances and those they have under
the best of the other languages, which is how a text of no learned language looks.  The
level is chosen for short runs of words and for whole texts and depends on the length.

Defined results: a null text or one without a letter is ``und`` with score 0 and is
rejected; equal cross-entropies go to the language that sorts first; rows without a
language teach nothing, and so do held-out rows, whose languages are not even known by
name; with nothing learned every text is ``und``; a column named like an output is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .shared import stored
from .toxicity import fold

#: Letters and combining marks make words; all else sets them apart.
WORD = "\\p{L}\\p{M}"
#: Standard deviations (of a text of its length) beyond the mean at which a text is rejected if one language alone is learned.
REJECT_AT = 12.0
#: The rejection is chosen on about so many training texts a language, by hash, and at most this share of them.
CALIBRATION_ROWS, CALIBRATION_SHARE = 2_000, 0.1
#: Languages with fewer texts than this are counted whole and calibrated on counted texts.
LEAST_TEXTS = 100
#: Words of the runs that stand for short texts; each calibration text gives one of each length, and itself.
RUNS = (8, 20)
#: Share of the texts of a learned language within its usual distance, and of the others' texts below theirs.
USUAL, UNUSUAL = 0.999, 0.01
_SHARES = 1 << 30


@dataclass
class LanguageModel:
    model: kn.Model | None
    languages: list[str]
    mean: np.ndarray
    spread: np.ndarray  # of a character's surprise; a text of n characters varies by spread / sqrt(n) besides its floor
    floor: np.ndarray
    lengths: np.ndarray = field(default_factory=lambda: np.ones(1))  # in characters, ascending
    levels: np.ndarray = field(default_factory=lambda: np.full(1, REJECT_AT))  # the distance at which texts of each length are rejected
    kept: np.ndarray = field(default_factory=lambda: np.empty(0))  # share of calibration texts that each level keeps
    caught: np.ndarray = field(default_factory=lambda: np.empty(0))  # and that it rejects where their language is left out

    def distance(self, language: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many standard deviations of a text of ``n`` characters a cross-entropy is beyond its language's mean."""
        return (h - self.mean[language]) / np.sqrt(self.floor[language] ** 2 + self.spread[language] ** 2 / np.maximum(n, 1))

    def level(self, n: np.ndarray) -> np.ndarray:
        return np.interp(np.log(np.maximum(n, 1)), np.log(self.lengths), self.levels)

    def judge(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, from its cross-entropies and characters: number of the best language, its score and whether it is rejected."""
        best = h.argmin(1)
        own = h[np.arange(len(h)), best]
        gap = np.minimum((h - own[:, None]) * np.minimum(n, 200)[:, None], 700)
        score = 1 / np.exp(-gap).sum(1)
        return best, np.where(n > 0, score, 0.0), (n == 0) | (self.distance(best, own, n) > self.level(n))

    def calibrate(self, run: np.ndarray, cls: np.ndarray, own: np.ndarray, other: np.ndarray, other_h: np.ndarray, n: np.ndarray) -> None:
        """Set means, spreads and levels from calibration texts.

        ``run`` is 0 for whole texts and else the words of a run; ``own`` is the
        cross-entropy under the text's language, ``other_h`` the lowest under another
        language, ``other``, which is -1 where there is none.
        """
        for k in range(len(self.languages)):
            mine = cls == k
            whole, short = mine & (run == 0), mine & (run == min(RUNS))
            if not mine.any():
                self.mean[k] = np.inf  # nothing is known of it, so nothing is rejected
                continue
            middle = np.median(own[whole])
            self.mean[k] = middle
            self.floor[k] = np.median(np.abs(own[whole] - middle)) * 1.4826 + 0.02
            self.spread[k] = np.median(np.abs(own[short] - middle) * np.sqrt(n[short])) * 1.4826 + 0.5
        right = (other < 0) | (own <= other_h)  # a text that another language fits better may be labelled wrongly
        lengths, levels, kept, caught = [], [], [], []
        for r in (*RUNS, 0):
            mine = right & (run == r) & np.isfinite(self.mean[cls])
            if not mine.any() or (other[mine] < 0).any():
                continue
            far = np.isfinite(self.mean[other]) & mine
            usual = self.distance(cls[mine], own[mine], n[mine])
            unlearned = self.distance(other[far], other_h[far], n[far])
            top, low = np.quantile(usual, USUAL), np.quantile(unlearned, UNUSUAL) if len(unlearned) else REJECT_AT
            level = (top + low) / 2 if low > top else 1.1 * max(top, 1.0)
            lengths.append(max(float(np.median(n[mine])), 1.0))
            levels.append(level)
            kept.append((usual <= level).mean())
            caught.append((unlearned > level).mean() if len(unlearned) else np.nan)
        if lengths:
            by_length = np.argsort(lengths, kind="stable")
            self.lengths, self.levels, self.kept, self.caught = (np.asarray(x)[by_length] for x in (lengths, levels, kept, caught))


def entropies(model: kn.Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in nats a character by language, and the characters of each text."""
    sums = kn.by_slices(column, lambda c: kn.scorer(model).sums(c)[0])
    length = np.maximum(sums[:, -1], 1)
    return -sums[:, :-1] / length[:, None], sums[:, -1]


def has_words(text: Column) -> Column:
    """Whether the normal words of a text are not empty, found without making them."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(f"[{WORD}]")


def fit(docs: DataFrame, order: int = 5, hash_bits: int = 64, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel | None:
    """Learn from ``docs`` (doc_id, text, lang), without ids whose crc32 mod 4 is 2.

    Texts chosen by hash of the id, about ``calibration_rows`` a language and at most
    ``CALIBRATION_SHARE`` of them, choose the rejection and are not counted; all others
    are.  A language with fewer than ``LEAST_TEXTS``, or whose ids leave nothing else, is
    counted whole.
    """
    spark = docs.sparkSession
    # texts are counted, joined and drawn as they are, and normalised only where their words are read
    norm = kn.normal_words(F.col("text"), WORD).alias("norm")
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) % 4 != 2) & has_words(F.col("text")))
    known = known.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)))
    drawn = F.count_if(F.col("draw") < int(CALIBRATION_SHARE * _SHARES))
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), drawn.alias("drawn")).limit(kn.MAX_CLASSES + 1).collect()  # train() refuses more
    if not rows:
        return None
    languages = sorted(r["lang"] for r in rows)
    apart = {r["lang"]: r["count"] >= LEAST_TEXTS and 0 < r["drawn"] <= r["count"] // 2 for r in rows}
    shares = {r["lang"]: min(CALIBRATION_SHARE if apart[r["lang"]] else 1.0, calibration_rows / r["count"]) for r in rows}
    numbers = [(k, v, int(shares[k] * _SHARES), apart[k]) for v, k in enumerate(languages)]
    numbers = spark.createDataFrame(numbers, "lang string, cls int, below long, apart boolean")
    known = known.join(F.broadcast(numbers), "lang")  # at most MAX_CLASSES rows, else train() refuses
    chosen = F.col("draw") < F.col("below")
    counts = stored(kn.word_counts(known.filter(~(chosen & F.col("apart"))).select("cls", norm)), "language-words")
    model = kn.train(counts, order, hash_bits, len(languages))
    fitted = LanguageModel(model, languages, *(np.zeros(len(languages)) for _ in range(3)))
    held = kn.shared_model(spark, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = entropies(held.value, batch.column("norm"))
            at, cls = np.arange(len(h)), np.asarray(batch.column("cls"))
            own = h[at, cls]
            h[at, cls] = np.inf
            other = h.argmin(1) if len(h) else cls
            other_h = h[at, other]
            columns = [batch.column("run"), batch.column("cls"), pa.array(own), pa.array(np.where(np.isfinite(other_h), other, -1).astype(np.int32)), pa.array(other_h), pa.array(n)]
            yield pa.record_batch(columns, names=["run", "cls", "own", "other", "other_h", "n"])

    words = F.split("norm", " ")

    def some(count: int) -> Column:
        start = F.pmod(F.xxhash64("doc_id", F.lit(count)), F.greatest(F.size(words) - count + 1, F.lit(1))).cast("int")
        return F.struct(F.lit(count).alias("run"), F.array_join(F.slice(words, start + 1, F.lit(count)), " ").alias("norm"))

    parts = F.explode(F.array(F.struct(F.lit(0).alias("run"), F.col("norm")), *(some(r) for r in RUNS)))
    parts = known.filter(chosen).select("doc_id", "cls", norm).select("cls", parts.alias("part")).select("cls", "part.*")
    rows = parts.mapInArrow(measure, "run int, cls int, own double, other int, other_h double, n double").toArrow()
    fitted.calibrate(*(np.asarray(rows.column(c)) for c in rows.column_names))
    return fitted


def with_language(df: DataFrame, fitted: LanguageModel | None, text: str = "text", output: str = "language") -> DataFrame:
    """Add a struct (lang, score, rejected) about each whole text."""
    kind = "struct<lang string, score double, rejected boolean>"
    if fitted is None:
        return df.withColumn(output, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).cast(kind))
    held, light = kn.shared_model(df.sparkSession, fitted.model), replace(fitted, model=None)

    @F.arrow_udf(kind)
    def judge(column: pa.Array) -> pa.Array:
        best, score, rejected = light.judge(*entropies(held.value, column))
        named = pa.array([*light.languages, "und"]).take(pa.array(np.where(score > 0, best, len(light.languages))))
        return pa.StructArray.from_arrays([named, pa.array(score), pa.array(rejected)], ["lang", "score", "rejected"])

    return df.withColumn(output, judge(kn.normal_words(F.when(F.col(text).rlike("\\p{L}"), F.col(text)), WORD)))
