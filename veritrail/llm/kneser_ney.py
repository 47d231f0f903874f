"""Interpolated Kneser-Ney models over the characters of words, one for each class.

A word is padded with ``order - 1`` start marks and one end mark and scored character by
character.  The highest order keeps raw counts for each class; every lower order keeps
continuation counts (in how many distinct contexts a gram was seen), either for each
class or pooled over all classes, which smooths what a class has rarely seen.

Counting is distributed: words are counted in Arrow batches, summed by Spark, cut into
grams by Spark expressions and summed again.  Grams are then keyed by ``hash_bits`` bits
of a hash; with 64, as the operators use, every gram has a key of its own (a billion
grams share one with a probability of 0.03).  A model so has as many keys as the corpus
has distinct grams and grows with it.  Counts are kept by key and context, so every
context has its own total.  Each order is a sorted array of keys with a row of values by
class, looked up by binary search.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import stored

_START, _END = "\u0002", "\u0003"
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Most classes of a model; each adds a column of values to every order.
MAX_CLASSES = 256
#: Words scored at once, which bounds the working arrays of a batch of new words.
SCORED_WORDS = 4096


def normal_words(text: Column, keep: str = "\\p{L}\\p{M}\\p{N}") -> Column:
    """Lower-cased text whose words (runs of ``keep``) are set apart by single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{keep}]+", " "))


def word_counts(df: DataFrame) -> DataFrame:
    """(cls, word, n) of a table (cls int, norm string)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "norm"):
                seg = tb.words(*tb.text_bytes(batch.column("norm")))
                if not len(seg.starts):
                    continue
                codes, distinct = seg.distinct()
                key, n = np.unique(np.asarray(batch.column("cls"))[seg.rows].astype(np.int64) * len(distinct) + codes, return_counts=True)
                words = pa.array(distinct, pa.binary()).take(pa.array(key % len(distinct))).cast(pa.string())
                yield pa.record_batch([pa.array((key // len(distinct)).astype(np.int32)), words, pa.array(n)], names=["cls", "word", "n"])

    return df.select("cls", "norm").mapInArrow(count, "cls int, word string, n long").groupBy("cls", "word").agg(F.sum("n").alias("n"))


def _keys(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Keys of the grams of ``order`` that end at each place of a code-point array (zeros before its start)."""
    h = np.full(len(codes), order, np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = codes if not back else np.concatenate([np.zeros(back, np.uint64), codes[:-back]])
        h = (h ^ shifted) * _STEP
        h ^= h >> np.uint64(29)
    return tb.mix64(h) >> np.uint64(64 - bits)


def _gram_levels(counts: DataFrame, order: int, shared: int) -> list[tuple[int, DataFrame]]:
    """(cls, gram, n) of every order: raw counts on top, continuation counts below, pooled in orders up to ``shared``."""
    padded = F.concat(F.lit(_START * (order - 1)), F.col("word"), F.lit(_END))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))
    top = counts.select("cls", "n", F.explode(grams).alias("gram")).groupBy("cls", "gram").agg(F.sum("n").cast("double").alias("n"))
    levels = [(order, top)]
    for m in range(order - 1, 0, -1):
        above = levels[-1][1].select(F.lit(0).alias("cls") if m <= shared else F.col("cls"), "gram")
        if m == shared:
            above = above.distinct()
        below = above.groupBy("cls", F.substring("gram", 2, m).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        levels.append((m, below))
    return levels


def _hashed(level: DataFrame, order: int, bits: int) -> DataFrame:
    """(m, cls, key, ctx, n): grams by hash key, with the key of their context."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            at = np.arange(order - 1, len(codes), order)
            if order > 1:
                context = _keys(codes, order - 1, bits)[at - 1]
            else:
                context = np.zeros(len(at), np.uint64)
            key = _keys(codes, order, bits)[at]
            yield pa.record_batch(
                [pa.array(np.full(len(at), order, np.int32)), batch.column("cls"), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), batch.column("n")],
                names=["m", "cls", "key", "ctx", "n"],
            )

    return level.select("cls", "gram", "n").mapInArrow(keyed, "m int, cls int, key long, ctx long, n double")


@dataclass
class Level:
    keys: np.ndarray
    probs: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray


@dataclass
class Model:
    """A trained model; ``levels[m - 1]`` has the grams of order m."""

    order: int
    bits: int
    classes: int
    levels: list[Level] = field(default_factory=list)
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log-likelihood of each word by class, and its characters with the end mark: shape (words, classes + 1)."""
        parts = [self._some_scores(words[k : k + SCORED_WORDS]) for k in range(0, max(len(words), 1), SCORED_WORDS)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _some_scores(self, words: list[bytes]) -> np.ndarray:
        pad = _START * (self.order - 1)
        text = "".join(f"{pad}{w.decode()}{_END}" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.flatnonzero(codes == ord(_END))
        lengths = np.diff(ends, prepend=-1) - (self.order - 1)
        at = np.flatnonzero(codes != ord(_START))
        p = np.full((len(at), self.classes), 1e-6, np.float64)
        for m, level in enumerate(self.levels, 1):
            context = _keys(codes, m - 1, self.bits)[at - 1] if m > 1 else np.zeros(len(at), np.uint64)
            found, has = _find(level.contexts, context)
            p *= np.where(has[:, None], level.backoffs[found], 1.0)
            found, has = _find(level.keys, _keys(codes, m, self.bits)[at])
            p += np.where(has[:, None], level.probs[found], 0.0)
        out = np.empty((len(words), self.classes + 1), np.float32)
        first = np.cumsum(lengths) - lengths
        out[:, :-1] = np.add.reduceat(np.log(p), first, axis=0) if len(first) else 0
        out[:, -1] = lengths
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    unique, back = np.unique(wanted, return_inverse=True)  # a search in order stays in the cache
    at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
    return at[back], (keys[at] == unique)[back]


def train(counts: DataFrame, order: int, hash_bits: int, classes: int, shared: int = 0) -> Model:
    """Build a model from (cls, word, n).

    The counts by key are stored, and the driver receives them an order at a time: a row
    for each class and distinct gram.  Classes are at most ``MAX_CLASSES``.  Orders up to
    ``shared`` are pooled.
    """
    if classes > MAX_CLASSES:
        raise ValueError(f"{classes} classes; a model has at most {MAX_CLASSES}")
    parts = [_hashed(level, m, hash_bits) for m, level in _gram_levels(counts, order, shared)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = stored(table.groupBy("m", "cls", "key", "ctx").agg(F.sum("n").alias("n")), "gram-counts")
    model = Model(order, hash_bits, classes)
    for m in range(1, order + 1):
        rows = table.filter(F.col("m") == m).select("cls", "key", "ctx", "n").toArrow()
        cls, key, ctx, n = (np.asarray(rows.column(c)) for c in ("cls", "key", "ctx", "n"))
        key, ctx = key.view(np.uint64), ctx.view(np.uint64)
        columns = 1 if m <= shared else classes
        keys, contexts = np.unique(key), np.unique(ctx)
        probs = np.zeros((len(keys), columns), np.float32)
        backoffs = np.ones((len(contexts), columns), np.float32)
        for c in range(columns):
            mine = cls == c
            if not mine.any():
                continue
            count, at = n[mine], np.searchsorted(contexts, ctx[mine])
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(at, count, len(contexts))
            types = np.bincount(at, minlength=len(contexts))
            np.maximum.at(probs[:, c], np.searchsorted(keys, key[mine]), (np.maximum(count - discount, 0) / total[at]).astype(np.float32))
            seen = total > 0
            backoffs[seen, c] = discount * types[seen] / total[seen]
        model.levels.append(Level(keys, probs, contexts, backoffs))
    return model


class DocumentScorer:
    """Scores of whole texts by their words; a worker scores each distinct word once."""

    def __init__(self, model: Model):
        self.model = model
        self._cache = tb.SegmentCache(model.word_scores)

    def words(self, column: pa.Array) -> tuple[tb.Segments, np.ndarray, np.ndarray]:
        """The words of a column, the number of each's distinct word, and scores by distinct word."""
        seg = tb.words(*tb.text_bytes(column))
        if not len(seg.starts):
            return seg, np.empty(0, np.int64), np.empty((0, self.model.classes + 1), np.float32)
        return seg, *self._cache.find(seg)

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By row: log-likelihood by class with the characters in the last column, and the words."""
        seg, codes, table = self.words(column)
        out = np.zeros((len(column), self.model.classes + 1))
        for c in range(out.shape[1] if len(codes) else 0):
            out[:, c] = np.bincount(seg.rows, table[codes, c], len(column))
        return out, seg.per_row


def scorer(model: Model) -> DocumentScorer:
    """The scorer of a model; it and the words it has scored stay in the worker process until it needs another model."""
    return tb.only(model.uid, lambda: DocumentScorer(model))


_broadcast: dict[str, Broadcast] = {}


def shared_model(spark: SparkSession, model: Model) -> Broadcast:
    """The broadcast of a model.  Executors drop the copy of the model before it, and fetch it again if it is still asked for."""
    if model.uid not in _broadcast:
        for held in _broadcast.values():
            held.unpersist()
        _broadcast.clear()
        _broadcast[model.uid] = spark.sparkContext.broadcast(model)
    return _broadcast[model.uid]


def by_slices(column: pa.Array, score) -> np.ndarray:
    """Apply ``score`` (column of strings to rows of numbers) to slices of bounded bytes."""
    parts = [score(part.column(0)) for part in tb.slices(pa.record_batch([column], ["text"]), "text")]
    return np.concatenate(parts) if parts else score(column)
