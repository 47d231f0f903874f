"""Product codes of vectors: codebooks by Lloyd rounds that shuffle only what changed.

A vector is cut into equal parts, and each part position has a codebook of its own.  All
arithmetic is on integers.  The running state of a round is the sums and counts of every
codebook entry, a few thousand integers.  The previous assignments are persisted as a table
bucketed like the vectors, so that the two meet without a shuffle; a task compares its
new assignments with them and reports, added up, only the plus and minus contributions of
the parts that moved.  Those sums are all that a round shuffles.

Defined results: rows whose vector is null, empty or has a null or non-finite component are
dropped, and so are rows of another width than the vector with the smallest id; equal ids
are ordered by their vectors, null ids come last; components beyond ``LARGEST`` in
magnitude count as that, so that no sum of squares overflows; with fewer kept rows than
entries, codebooks are that much smaller; an empty table gives no codebooks and no codes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, shared_dir, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 27
#: Rows of a bucket, which a task reads with their previous assignments.
BUCKET_ROWS = 200_000
DELTA = "array<struct<part:int,entry:int,count:long,sums:array<long>>>"


@dataclass(frozen=True)
class Codebooks:
    """``entries`` is an integer array of (part, entry, position within the part)."""

    entries: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


@contextmanager
def bucketed(spark: SparkSession, buckets: int) -> Iterator:
    """Gives ``put(df)``, which writes a DataFrame bucketed by ``row`` and returns it as read; names last for the block."""
    names: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        names.append(f"delta_lloyd_{uuid.uuid4().hex}")
        df.write.format("parquet").bucketBy(buckets, "row").option("path", f"{shared_dir(spark)}/{names[-1]}").saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield put
    finally:
        for name in names:  # the files stay, as for every stored table
            spark.sql(f"drop table if exists {name}")


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vec) of the usable rows, with components as scaled integers."""
    vec = F.col(embedding).cast("array<double>")
    usable = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = vectors.filter(F.col(embedding).isNotNull() & usable).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("vec"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(1).select(F.size("vec").alias("width")).first()
    if first is None:
        return kept
    if first["width"] % parts:
        raise ValueError(f"vectors of {first['width']} components cannot be cut into {parts} equal parts")
    return kept.filter(F.size("vec") == first["width"])


def _matrix(column: pa.ListArray, parts: int) -> np.ndarray:
    """Vectors of a batch as integers by (row, part, position)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1) if len(column) else np.zeros((0, parts, 1), np.int64)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, by (row, part); ties go to the lower index."""
    index, error = (np.zeros(vectors.shape[:2], np.int64) for _ in range(2))
    for part in range(vectors.shape[1]):
        gaps = np.stack([((vectors[:, part] - entry) ** 2).sum(axis=1) for entry in entries[part]], axis=1)
        index[:, part] = gaps.argmin(axis=1)
        error[:, part] = gaps[np.arange(len(gaps)), index[:, part]]
    return index, error


def contributions(vectors: np.ndarray, was: np.ndarray, now: np.ndarray, entries: int) -> list[dict]:
    """Sums and counts that entries gain and lose; ``was`` is -1 where a part has no assignment yet."""
    found = []
    for part in range(vectors.shape[1]):
        moved = np.flatnonzero(was[:, part] != now[:, part])
        sums, counts = np.zeros((entries, vectors.shape[2]), np.int64), np.zeros(entries, np.int64)
        for side, sign in ((now, 1), (was, -1)):
            rows = moved[side[moved, part] >= 0]
            np.add.at(sums, side[rows, part], sign * vectors[rows, part])
            np.add.at(counts, side[rows, part], sign)
        changed = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        found += [{"part": part, "entry": int(e), "count": int(counts[e]), "sums": sums[e].tolist()} for e in changed]
    return found


def _assigned(vectors: DataFrame, before: DataFrame | None, entries: np.ndarray) -> DataFrame:
    """(row, code, delta): a byte a part, and in the first row of each batch what the batch contributes."""
    parts, n = entries.shape[:2]
    both = vectors.select("row", "vec").withColumn("was", F.lit(None).cast("binary"))
    if before is not None:
        both = vectors.select("row", "vec").join(before.select("row", F.col("code").alias("was")).hint("shuffle_hash"), "row")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch.column("vec"), parts)
            now, _ = nearest(vecs, entries)
            old = batch.column("was").to_pylist()
            was = np.full(now.shape, -1) if old[0] is None else np.frombuffer(b"".join(old), np.uint8).reshape(now.shape).astype(np.int64)
            delta = [contributions(vecs, was, now, n), *[None] * (batch.num_rows - 1)]
            codes = [r.tobytes() for r in now.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.binary()), pa.array(delta, kind)], names=["row", "code", "delta"])

    return both.mapInArrow(assign, f"row long, code binary, delta {DELTA}")


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks for kept vectors (vec_id, vec); None if there are none.  At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an assignment is kept in a byte: at most 256 entries")
    spark = vectors.sparkSession
    first = [r["vec"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").collect()]
    if not first:
        return None
    book = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    rows = vectors.count()
    buckets = min(max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)), 100_000)
    counts, sums = [[0] * len(first) for _ in range(parts)], [[[0] * book.shape[2] for _ in first] for _ in range(parts)]
    with bucketed(spark, buckets) as put:
        numbered = stored(vectors.select(F.monotonically_increasing_id().alias("row"), "vec"), "delta-vectors")
        held, before = put(numbered.repartition(buckets, "row")), None
        for _ in range(rounds):
            before = put(_assigned(held, before, book))
            change = before.filter("delta is not null").select(F.inline("delta"))
            totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(book.shape[2])]
            for r in change.groupBy("part", "entry").agg(F.sum("count").alias("count"), *totals).collect():  # at most one row an entry
                p, e = r["part"], r["entry"]
                counts[p][e] += r["count"]
                sums[p][e] = [s + int(r[f"s{k}"]) for k, s in enumerate(sums[p][e])]
            for p in range(parts):
                for e, count in enumerate(counts[p]):
                    if count:
                        book[p, e] = [s // count for s in sums[p][e]]
    return Codebooks(book)


def with_codes(vectors: DataFrame, books: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """Add ``code``, two hex digits a part, and ``error``, the squared distance to what it stands for."""
    entries = books.entries

    @F.arrow_udf("struct<code:string,error:long>")
    def encode(vecs: pa.Array) -> pa.Array:
        index, gap = nearest(_matrix(vecs, entries.shape[0]), entries)
        codes = [r.tobytes().hex() for r in index.astype(np.uint8)]
        return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(gap.sum(axis=1), pa.int64())], names=["code", "error"])

    return vectors.withColumn("_encoded", encode("vec")).withColumns({code: F.col("_encoded.code"), error: F.col("_encoded.error")}).drop("_encoded")


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The integer vectors that codes stand for."""
    index = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), -1)
    return np.concatenate([books.entries[p, index[:, p]] for p in range(index.shape[1])], axis=1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error of all rows with an equal label, nulls together; null where it is no 64-bit number."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("_sum"))
    sums = stored(sums.select("_label", F.expr("try_cast(_sum as bigint)").alias("label_error")), "delta-labels")
    small = sums.count() <= BROADCAST_ROWS
    return coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
