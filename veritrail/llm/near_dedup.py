"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a bag of word shingles weighted by how often each occurs.  Every element owns
a stream of darts thrown by hashing at the plane of weight and time; those below its
weight count, and a signature keeps the earliest dart of each coordinate.  Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.  The
time up to which darts are thrown shrinks with a text's total weight, so all texts throw
about as many.

Bands of coordinates are joined by hash.  A text is first compared with the smallest text
of all its bands only, one pair a text.  Once the confirmed links are components, buckets
that still hold several components go through turns.  In a small one all pairs between
components are compared; in a large one every text outside its largest component is
compared with a few leaders of that component, which then leave the bucket.  After
``TURNS`` turns, shingles that at most ``RARE`` of the remaining texts have are joined:
texts that share one are compared, and for all others the weight of common shingles
bounds the similarity, so texts out of reach of their bucket leave it.  All pairs that
are left are compared at once where they are at most ``PAIRS_A_ROW`` for each row of the
buckets that still hold several components, or, once the bound has thinned these, of all
buckets.  Every step forms at most a constant number of pairs for each row, and at the
end each pair that a bucket offers is in one component, was compared, or is ruled out by
the bound.

Defined results: copies are texts with equal words in order (letter case and punctuation
aside), and null or wordless texts are copies of one another; a text shorter than a
shingle is one shingle; an id that names several texts comes back once for each, with
the class of that text; repeated rows come back repeated; rows with a null id come back
with a null class; of the other columns none is read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .components import components
from .kneser_ney import normal_words
from .shared import BROADCAST_ROWS, stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 24 bands of 5: a pair at similarity 0.8 meets in a band with probability 0.99993.
BANDS, BAND_ROWS = 24, 5
#: Leaders of a bucket in one turn; buckets with at most PAIRS_A_ROW times as many pairs as rows are compared whole.
LEADERS, PAIRS_A_ROW = 4, 4
#: Turns with leaders before the rare shingles are joined, and again between two such joins; texts that may share a rare shingle.
TURNS, RARE = 2, 8
#: Texts sketched at once; each throws about a thousand darts, however short it is.
SKETCH_ROWS = 256
_KEY_BITS = np.uint64(44)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def elements(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row << 44 | shingle hash) keys and how often each occurs."""
    seg = tb.words(data, offsets)
    h, n = tb.hashes(seg), seg.per_row
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.cumsum(n) - n
    at = tb.gather_ragged(np.arange(len(h)), first, count)
    rows = np.repeat(np.arange(len(n), dtype=np.uint64), count)
    last = np.repeat(first + n - 1, count)
    shingle = np.zeros(len(at), np.uint64)
    for k in range(size):
        own = at + k
        word = np.where(own <= last, h[np.minimum(own, len(h) - 1)], np.uint64(0)) if len(h) else shingle
        shingle = (shingle * np.uint64(0xD1342543DE82EF95)) ^ word
    keys = rows << _KEY_BITS | tb.mix64(shingle) >> (np.uint64(64) - _KEY_BITS)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(starts, append=len(keys))


def _throw(rows: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts of weighted elements up to a time by element: row, time and hash.

    Strip 0 of the weight axis is [0, 1), strip s is [2**(s-1), 2**s).  Time is cut into
    cells in which a strip expects one dart; arrivals in a cell follow one another by
    exponential gaps that depend on element, strip, cell and rank alone.
    """
    tops = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), tops + 1)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(tops + 1) - tops - 1, tops + 1)
    low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
    width = np.where(strip > 0, low, 1.0)
    cells = np.maximum(np.ceil(until[at] * width), 1).astype(np.int64)
    item = np.repeat(np.arange(len(at)), cells)
    cell = np.arange(len(item)) - np.repeat(np.cumsum(cells) - cells, cells)
    at, low, width, strip = at[item], low[item], width[item], strip[item]
    seed = tb.mix64(element[at] * _GOLDEN + tb.mix64((strip.astype(np.uint64) << np.uint64(40)) + cell.astype(np.uint64)))
    time = cell / width
    end = np.minimum((cell + 1) / width, until[at])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rank = 0
    while len(at):
        rank += 1
        h = tb.mix64(seed + np.uint64(rank * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        lives = time < end
        at, low, width, seed, time, end, h = (x[lives] for x in (at, low, width, seed, time, end, h))
        height = low + width * ((tb.mix64(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        hits = height < weight[at]
        found.append((rows[at[hits]], time[hits], h[hits]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (rows[:0], np.empty(0), element[:0])


def signatures(keys: np.ndarray, counts: np.ndarray, n: int, k: int = BANDS * BAND_ROWS) -> np.ndarray:
    """A row of k dart hashes for each of n bags; zeros for an empty bag."""
    rows, element, weight = (keys >> _KEY_BITS).astype(np.int64), keys & ((np.uint64(1) << _KEY_BITS) - np.uint64(1)), counts.astype(float)
    total = np.bincount(rows, weight, n)
    until = k * (np.log(k) + 3) / np.maximum(total, 1)
    out = np.zeros((n, k), np.uint64)
    pending = total > 0
    while pending.any():
        mine = pending[rows]
        row, time, h = _throw(rows[mine], element[mine], weight[mine], until[rows[mine]])
        slot = row * k + (tb.mix64(h ^ _GOLDEN) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-time)
        flat = np.zeros(n * k, np.uint64)
        flat[slot[order]] = h[order]  # the earliest is written last
        flat = flat.reshape(n, k)
        done = pending & flat.all(1)
        out[done] = flat[done]
        pending &= ~done
        until = until * 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        h = tb.mix64((h ^ parts[:, :, k]) + _GOLDEN)
    return h.astype(np.int64)


@F.arrow_udf(T.StructType([T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def sketch(norm: pa.Array) -> pa.Array:
    """Total weight and band hashes of texts of space-separated words."""
    weights, bands = [np.empty(0, np.int64)], [np.empty((0, BANDS), np.int64)]
    for part in tb.slices(pa.record_batch([norm], ["t"]), "t", max_rows=SKETCH_ROWS):
        keys, counts = elements(*tb.text_bytes(part.column(0)))
        weights.append(np.bincount((keys >> _KEY_BITS).astype(np.int64), counts, part.num_rows).astype(np.int64))
        bands.append(band_hashes(signatures(keys, counts, part.num_rows)))
    weight, band = np.concatenate(weights), np.concatenate(bands)
    some = weight > 0
    offsets = np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel()))
    return pa.StructArray.from_arrays([pa.array(weight), listed], ["weight", "bands"])


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Weighted Jaccard similarity of the shingle bags of two texts of space-separated words."""
    out = [np.empty(0)]
    size = pa.compute.add(pa.compute.binary_length(a), pa.compute.binary_length(b))
    ends, at = np.cumsum(np.asarray(size, dtype=np.int64)), 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * tb.SLICE_BYTES, "right")))
        (ka, ca), (kb, cb) = (elements(*tb.text_bytes(x.slice(at, to - at))) for x in (a, b))
        place = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
        both = (kb[place] == ka) if len(kb) else np.zeros(len(ka), bool)
        common = np.bincount((ka[both] >> _KEY_BITS).astype(np.int64), np.minimum(ca[both], cb[place[both]]), to - at)
        total = sum(np.bincount((k >> _KEY_BITS).astype(np.int64), c, to - at) for k, c in ((ka, ca), (kb, cb)))
        out.append(common / np.maximum(total - common, 1))
        at = to
    return pa.array(np.concatenate(out))


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.  The side that repeats, a, is joined last."""
    right = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b")), "b")
    full = right.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a")), "a")
    return full.filter(similarity("norm_a", "norm_b") >= threshold).select("a", "b")


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, element, w): the weighted shingles of texts (node, norm)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "norm"):
                keys, counts = elements(*tb.text_bytes(batch.column("norm")))
                node = batch.column("node").take(pa.array((keys >> _KEY_BITS).astype(np.int64)))
                element = (keys & ((np.uint64(1) << _KEY_BITS) - np.uint64(1))).astype(np.int64)
                yield pa.record_batch([node, pa.array(element), pa.array(counts.astype(np.int64))], names=["node", "element", "w"])

    return texts.select("node", "norm").mapInArrow(work, "node binary, element long, w long")


def _tallies(live: DataFrame) -> DataFrame:
    """By bucket that holds several components: its rows and pairs between components, the largest component and leaders of it."""
    rank = F.xxhash64("node", "bucket")
    leaders = [F.min(F.when(F.pmod(rank, F.lit(LEADERS)) == k, F.struct(rank.alias("h"), F.col("node").alias("node")))).alias(f"l{k}") for k in range(LEADERS)]
    parts = live.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), *leaders)
    named = F.filter(F.array(*(F.col(f"l{k}.node") for k in range(LEADERS))), lambda x: x.isNotNull())
    first = F.max_by(F.struct(F.col("component").alias("largest"), named.alias("leaders")), F.struct("n", "component")).alias("first")
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"), first)
    torn = whole.withColumn("pairs", (F.col("rows") * F.col("rows") - F.col("squares")) / 2).filter("pairs > 0")
    return torn.select("bucket", "rows", "pairs", "first.largest", "first.leaders")


def _in_reach(x: str, y: str, threshold: float) -> Column:
    """Whether two texts can be similar, by their weights and by the room that common shingles leave."""
    near = F.least(f"weight_{x}", f"weight_{y}") >= threshold * F.greatest(f"weight_{x}", f"weight_{y}")
    return near & (F.col(f"weight_{x}") <= F.col(f"room_{y}")) & (F.col(f"weight_{y}") <= F.col(f"room_{x}"))


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "weight", "room", "component")))


def _new_pairs(candidates: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of candidates with sides x and y, each once, that are in reach and were not compared before."""
    x, y = F.col("node_x"), F.col("node_y")
    pairs = candidates.filter(_in_reach("x", "y", threshold)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _bucket_pairs(live: DataFrame, tallies: DataFrame) -> DataFrame:
    """Candidates of one turn: in small buckets all pairs between components, in large ones pairs with leaders."""
    info = live.join(tallies, "bucket")
    minor = info.filter("component <> largest")
    all_of = _sided(live, "y").join(tallies.filter("small").select("bucket", "largest"), "bucket")
    whole = _sided(minor.filter("small"), "x").join(all_of, "bucket")
    whole = whole.filter((F.col("component_x") != F.col("component_y")) & ((F.col("component_y") == F.col("largest")) | (F.col("node_x") < F.col("node_y")))).drop("largest")
    led = info.filter(~F.col("small") & (F.col("component") == F.col("largest")) & F.array_contains("leaders", F.col("node")))
    led = _sided(minor.filter(~F.col("small")), "x").join(_sided(led, "y"), "bucket")
    return whole.unionByName(led)


def _rare_pairs(live: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``live`` texts that share a rare shingle, and (node, room): the most weight that a similar text without one can have."""
    nodes = live.select("node", "weight", "component").distinct()
    rows = stored(_shingles(texts.join(nodes.select("node"), "node", "left_semi")), "dedup-shingles")
    # a shingle of one text alone is known from the sums; only those of two to RARE texts are joined to their texts
    holders = rows.groupBy("element").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("node"), F.sum("w").alias("w"))
    holders = stored(holders.filter(F.col("count") <= RARE), "dedup-holders")
    held = stored(rows.join(holders.filter("count > 1").select("element"), "element"), "dedup-rare")
    own = held.select("node", "w").unionByName(holders.filter("count = 1").select("node", "w"))
    own = own.groupBy("node").agg(F.sum("w").alias("rare"))
    common = nodes.join(own, "node", "left").withColumn("common", F.col("weight") - F.coalesce("rare", F.lit(0)))
    room = common.select("node", ((1 + 1 / threshold) * F.col("common") - F.col("weight") + 1e-6).alias("room"))
    several = held.select("element", "node").join(nodes, "node").withColumn("room", F.lit(float("inf")))
    several = several.withColumnRenamed("element", "bucket")
    x, y = _sided(several, "x"), _sided(several, "y")
    return x.join(y, "bucket").filter((F.col("component_x") != F.col("component_y")) & (F.col("node_x") < F.col("node_y"))), room


def _joined(placed: DataFrame, label: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``placed`` with components joined along links (a, b) between nodes of ``label`` (node, component)."""
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    ties = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), rounds)
    new = ties.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return placed.join(new, "component", "left").withColumn("component", F.coalesce("to", "component")).select(placed.columns)


def _relabelled(live: DataFrame, links: DataFrame) -> DataFrame:
    """``live`` with components joined along new links (a, b) between its nodes.

    One round joins all that a leader links.  What it leaves apart costs further pairs, no link.
    """
    return _joined(live, live.select("node", "component").distinct(), links, rounds=1)


def _reachable(live: DataFrame) -> DataFrame:
    """Rows whose weight and room leave a text of another component in their bucket within reach."""
    parts = live.groupBy("bucket", "component").agg(F.min("weight").alias("weight"), F.max("room").alias("room"))
    lists = parts.groupBy("bucket").agg(
        F.min(F.struct("weight", "component")).alias("w"), F.max(F.struct("room", "component")).alias("r"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    # the best of the other components: the bucket's best, or the second best for rows of the best one's component
    second = parts.join(lists, "bucket").groupBy("bucket").agg(
        F.min(F.when(F.col("component") != F.col("w.component"), F.col("weight"))).alias("w2"), F.max(F.when(F.col("component") != F.col("r.component"), F.col("room"))).alias("r2")
    )
    best = lists.join(second, "bucket").select("bucket", "w", "r", "w2", "r2")
    least = F.when(F.col("component") == F.col("w.component"), F.col("w2")).otherwise(F.col("w.weight"))
    most = F.when(F.col("component") == F.col("r.component"), F.col("r2")).otherwise(F.col("r.room"))
    return live.join(best, "bucket").filter((F.col("weight") <= most) & (F.col("room") >= least)).select(live.columns)


def _links_beyond(meeting: DataFrame, first: DataFrame, star: DataFrame, texts: DataFrame, threshold: float) -> list[DataFrame]:
    """Links (a, b) between texts of one bucket that the components ``first`` keep apart, found in turns."""
    live = meeting.join(first, "node", "left").select("bucket", "node", "weight", F.lit(float("inf")).alias("room"), F.coalesce("component", "node").alias("component"))
    live = stored(live, "dedup-placed")
    links, tried, rows, thinned = [], star, live.count(), False
    for turn in count(1):
        tallies = stored(_tallies(live), "dedup-buckets-torn")
        sizes = tallies.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not sizes["n"]:
            return links
        # rows that nothing else is compared for must not pay for large buckets that the bound has not thinned yet
        last = sizes["pairs"] <= PAIRS_A_ROW * (rows if thinned else sizes["rows"])
        small = F.lit(True) if last else F.col("pairs") <= PAIRS_A_ROW * F.col("rows")
        tallies = tallies.withColumn("small", small)
        if sizes["n"] <= BROADCAST_ROWS:
            tallies = F.broadcast(tallies)
        pairs = stored(_new_pairs(_bucket_pairs(live, tallies), tried, threshold), "dedup-pairs")
        found = stored(_linked(pairs, texts, threshold), "dedup-more-links")
        links.append(found)
        if last:
            return links
        rest = live.join(tallies.filter("not small"), "bucket").filter(~F.array_contains("leaders", F.col("node")))
        live, tried = rest.select(live.columns), tried.unionByName(pairs)
        if not found.isEmpty():
            live = _relabelled(stored(live, "dedup-live"), found)
        live = stored(live, "dedup-live")
        if turn % TURNS == 0 and not live.isEmpty():
            candidates, room = _rare_pairs(live, texts, threshold)
            pairs = stored(_new_pairs(candidates, tried, threshold), "dedup-rare-pairs")
            found = stored(_linked(pairs, texts, threshold), "dedup-rare-links")
            links.append(found)
            tried = tried.unionByName(pairs)
            live = live.drop("room").join(room, "node").select(live.columns)
            if not found.isEmpty():
                live = _relabelled(stored(live, "dedup-live"), found)
            live, thinned = stored(_reachable(stored(live, "dedup-live")), "dedup-live"), True
    return links


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy_of, class_id, links): for every row the smallest id with the same words, the smallest id of its
    class, and the links between different texts of the class that were confirmed by comparison."""
    norm = normal_words(F.col(text))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.alias("norm"))
    known = source.filter(F.col("doc_id").isNotNull())
    key = F.unhex(F.md5("norm"))
    sketched = stored(known.select("doc_id", key.alias("node"), sketch("norm").alias("s")).select("doc_id", "node", "s.weight", "s.bands"), "dedup-sketches")
    nodes = stored(sketched.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands")), "dedup-nodes")

    rows = nodes.select("node", "weight", "first", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "a")
    meeting = stored(rows.join(shared, "bucket"), "dedup-buckets")
    star = stored(meeting.filter("a < node").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "dedup-star")
    ids = stored(meeting.select(F.col("first").alias("doc_id")).distinct(), "dedup-ids")
    texts = known.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    texts = stored(texts.select(key.alias("node"), "norm").dropDuplicates(["node"]), "dedup-texts")
    links = stored(_linked(star, texts, threshold), "dedup-links")
    joined = stored(components(links), "dedup-components")
    more = _links_beyond(meeting.select("bucket", "node", "weight"), joined, star, texts, threshold)
    named = stored(nodes.select("node", "first").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "dedup-named")
    if more:  # their ends are components by now, so few edges are left to join
        more = stored(reduce(DataFrame.unionByName, more).distinct(), "dedup-all-more")
        links = links.unionByName(more)
        named = stored(_joined(named, named, more), "dedup-named")

    sizes = links.join(named.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    heads = named.groupBy("component").agg(F.min("first").alias("class_id")).join(sizes, "component", "left")
    classes = named.join(heads, "component").select("node", F.col("first").alias("copy_of"), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    own = sketched.select("doc_id", "node").join(classes, "node").select("doc_id", "copy_of", "class_id", "links")
    unknown = source.filter(F.col("doc_id").isNull()).select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("copy_of", "class_id", "links")))
    return own.unionByName(unknown)
