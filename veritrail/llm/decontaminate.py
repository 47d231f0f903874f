"""Benchmark passages in documents by spaced-seed hashing, with Spark expressions only.

A seed is a fixed mask over consecutive words; its zeros are positions it ignores.  The
hashes of masked words of benchmark items and documents are joined.  Each hit fixes an
alignment of item and document, which is then compared word by word: a window of
``WINDOW`` words with at most ``MISMATCHES`` substitutions is a leak.  The two seeds find
every such window: whatever two of thirteen positions differ, one of them fits between.

An item shorter than a window is its own window, with a mask of half its length and a
tolerance in proportion: one substitution from seven words on, which leaves a half whole.

Defined results: words are compared without letter case and punctuation; items are sought
in place whatever their length, so one of a word or two is found wherever it is said; a
document of fewer words than a window and the item have is judged by none; null or empty texts have no words; repeated rows of an id count once; rows with a
null id take no part; no other column is read, whatever its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kneser_ney import normal_words
from .shared import BROADCAST_ROWS, stored

#: Found by search as a pair that no two substitutions in thirteen words evade.
SEEDS = ("11101011", "110100111")
WINDOW, MISMATCHES = 13, 2


def tolerance(n: Column | int) -> Column | int:
    """The substitutions that a window of n words may have."""
    return F.floor(n * MISMATCHES / WINDOW).cast("int") if isinstance(n, Column) else n * MISMATCHES // WINDOW


def short_mask(n: int) -> str:
    """The mask for items of n words, fewer than a window: whole without tolerance, else of half the length, with a gap from four words on."""
    if not tolerance(n):
        return "1" * n
    half = n // 2
    return "1" * half if half < 4 else "11" + "0" + "1" * (half - 3)


def _with_words(rows: DataFrame, identity: str, text: str, named: str) -> DataFrame:
    """(``named``, words): hashes of each text's words in order; a null text has none."""
    norm = rows.select(F.col(identity).alias(named), normal_words(F.col(text)).alias("norm"))
    return norm.select(named, F.transform(F.filter(F.split("norm", " "), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"))


def _positions(n: Column, mask: str) -> Column:
    return F.greatest(n - len(mask) + 1, F.lit(0))


def _masked(words: Column, mask: str) -> Column:
    """The hash of the masked words at every position of a text; the mask is part of it, as a number."""
    kept = [k for k, c in enumerate(mask) if c == "1"]
    count = _positions(F.size(words), mask)
    hashes = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.lit(int(mask, 2)), *(F.get(words, i + k) for k in kept)))
    return F.when(count > 0, hashes).otherwise(F.array().cast("array<long>"))


def _seeded(rows: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """A row (keep..., seed, at) for each mask and position of ``words``."""
    all_of = rows.select(*keep, F.size("words").alias("_n"), F.posexplode(F.concat(*(_masked(F.col("words"), m) for m in masks))).alias("_k", "seed"))
    starts, total = [], F.lit(0)
    for m in masks:
        starts.append(total)
        total = total + _positions(F.col("_n"), m)
    at = reduce(lambda rest, k: F.when(F.col("_k") < starts[k + 1], F.col("_k") - starts[k]).otherwise(rest), reversed(range(len(masks) - 1)), F.col("_k") - starts[-1])
    return all_of.select(*keep, "seed", at.alias("at"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, matched, item_words): where each document holds words of an item.

    ``matched`` is the most words of the item that agree along one alignment, ``start`` the
    document's word at which its first leaking window begins.  The seeds of the benchmark
    are broadcast while they are at most ``BROADCAST_ROWS``; beyond that the join shuffles.
    """
    items = _with_words(benchmark, item_id, item_text, "item_id").dropna().distinct()
    items = stored(items.withColumn("item_words", F.size("words")).filter(F.col("item_words") > 0), "leak-items")
    lengths = items.filter(F.col("item_words") < WINDOW).select("item_words").distinct()
    masks = {r.item_words: short_mask(r.item_words) for r in lengths.collect()}  # fewer than WINDOW
    seeds = _seeded(items.filter(F.col("item_words") >= WINDOW), list(SEEDS), "item_id")
    for n, mask in sorted(masks.items()):
        seeds = seeds.unionByName(_seeded(items.filter(F.col("item_words") == n), [mask], "item_id"))
    seeds = stored(seeds.select("seed", "item_id", F.col("at").alias("item_at")), "leak-seeds")

    words = _with_words(docs.filter(F.col(doc_id).isNotNull()), doc_id, text, "doc_id")
    small = seeds.count() <= BROADCAST_ROWS
    met = _seeded(words, [*SEEDS, *sorted(set(masks.values()))], "doc_id").join(F.broadcast(seeds) if small else seeds, "seed")
    lines = stored(met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "leak-hits")

    ids = lines.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_ROWS
    suspects = words.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    pairs = suspects.join(lines, "doc_id").join(items.select("item_id", F.col("words").alias("item"), "item_words"), "item_id")
    first = F.greatest(-F.col("shift"), F.lit(0))
    last = F.least(F.col("item_words"), F.size("words") - F.col("shift")) - 1
    same = F.transform(F.sequence(first, last), lambda j: (F.get("words", j + F.col("shift")) == F.get("item", j)).cast("int"))
    aligned = pairs.filter(last >= first).select("doc_id", "item_id", "shift", "item_words", first.alias("first"), same.alias("same"))
    width = F.least(F.lit(WINDOW), F.col("item_words"))
    need = width - tolerance(width)
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x))
    judged = aligned.filter(F.size("same") >= width).withColumn("good", F.array_position(F.transform(sums, lambda x: x >= need), True))
    start = (F.col("shift") + F.col("first") + F.col("good") - 1).cast("long")
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x).cast("long")
    leaks = judged.filter("good > 0").select("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), start.alias("start"), matched.alias("matched"))
    best = F.max(F.struct("matched", (-F.col("start")).alias("before"))).alias("best")
    return leaks.groupBy("doc_id", "item_id", "item_words").agg(best).select(
        "doc_id", "item_id", (-F.col("best.before")).alias("start"), F.col("best.matched").alias("matched"), "item_words"
    )
