"""Exact inner-product search of whole tables of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, TOP_K = 0.35, 12
#: Query vectors that are broadcast at once; more are taken in blocks of so many.
QUERY_BLOCK = 4096


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def finite(vector: Column) -> Column:
    """NaN and infinite components as 0."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(vector, lambda x: F.when(bad(x.cast("double")), 0.0).otherwise(x.cast("double")))


def normalise(vector: Column) -> Column:
    """Unit vectors; zero vectors stay zero."""
    clean = finite(vector)
    length = norm(clean)
    return F.when(length > 0, F.transform(clean, lambda x: x / length)).otherwise(clean)


def is_normalised(vector: Column, tolerance: float = 1e-5) -> Column:
    length = norm(vector)
    return (F.size(vector) > 0) & ((F.abs(length - 1) <= tolerance) | (length == 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def _shared_keys(asked: list, held: list) -> np.ndarray:
    """Whether each asking row (None: everything) and each held row have a key in common."""
    codes: dict[str, int] = {}
    for keys in asked:
        for key in keys or ():
            codes.setdefault(key, len(codes))

    def marks(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), max(len(codes), 1)), np.float32)
        for r, keys in enumerate(rows):
            out[r, [codes[k] for k in keys or () if k in codes]] = 1
        return out

    return (marks(asked) @ marks(held).T > 0) | np.array([keys is None for keys in asked])[:, None]


def _blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """Rows of queries in blocks of ``QUERY_BLOCK``; the driver holds one block at a time."""
    block: list = []
    for row in queries.select(*columns).orderBy("qid").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _block_search(vectors: DataFrame, block: list, k: int | None, threshold: float | None, kind: str, scoped: bool) -> DataFrame:
    ids, matrix = np.array([r["qid"] for r in block]), np.array([r["vec"] for r in block], np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix, [r["keys"] for r in block] if scoped else None))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, keys = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = queries @ _matrix(batch.column("vec"), batch.num_rows).T
            if keys is not None:
                scores[~_shared_keys(keys, batch.column("keys").to_pylist())] = -np.inf
            if k is not None and k < batch.num_rows:
                cut = np.partition(scores, batch.num_rows - k, 1)[:, batch.num_rows - k, None]
                q, at = np.nonzero((scores >= cut) & (scores > -np.inf))  # with ties, which the final rank settles
            else:
                q, at = np.nonzero(scores > -np.inf)
            if threshold is not None:
                passes = scores[q, at] >= threshold
                q, at = q[passes], at[passes]
            yield pa.record_batch([pa.array(ids[q]), batch.column("position").take(pa.array(at)), pa.array(scores[q, at])], names=["qid", "position", "similarity"])

    return vectors.select("position", "vec", *(["keys"] if scoped else [])).mapInArrow(match, f"qid {kind}, position long, similarity double")


def _over_blocks(queries: DataFrame, columns: list[str], search, schema: str) -> DataFrame:
    found = None
    for block in _blocks(queries, columns):
        part = search(block)
        found = part if found is None else found.unionByName(part)
    return queries.sparkSession.createDataFrame([], schema) if found is None else found


def search(vectors: DataFrame, queries: DataFrame, k: int | None = TOP_K, threshold: float | None = None, scoped: bool = False) -> DataFrame:
    """(qid, position, similarity, rank): the k best vectors of each query; all that pass the threshold if k is None.

    ``vectors`` has (position, vec), ``queries`` (qid, vec), all of one width; a batch of
    vectors keeps its own best before anything is exchanged.  Null vectors match nothing.
    With ``scoped`` both have ``keys``, and a query meets only vectors that share one of
    its keys, all where its keys are null; others are masked inside the batch.
    """
    from .lexical import top

    vectors, queries = vectors.filter("vec is not null"), queries.filter("vec is not null")
    kind = dict(queries.dtypes)["qid"]
    found = _over_blocks(queries, ["qid", "vec", *(["keys"] if scoped else [])], lambda block: _block_search(vectors, block, k, threshold, kind, scoped), f"qid {kind}, position long, similarity double")
    return top(found, k if k is not None else 2**31 - 1, "similarity")


def similarities(vectors: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, position, similarity) of given pairs (qid, position) that have both vectors."""
    both = pairs.select("qid", "position").join(vectors.select("position", "vec"), "position").join(queries.select("qid", F.col("vec").alias("_q")), "qid")
    dot = F.aggregate(F.zip_with("vec", "_q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return both.filter("vec is not null and _q is not null").select("qid", "position", dot.alias("similarity"))


def counted_above(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """(qid, position, above): how many vectors that pass the threshold come before each pair (qid, position, similarity), by similarity and position.

    A query should have few pairs; each batch of vectors gives one count a pair.
    """
    vectors, queries = vectors.filter("vec is not null"), queries.filter("vec is not null")
    kind = dict(queries.dtypes)["qid"]
    wanted = queries.select("qid", "vec").join(pairs.filter("similarity is not null").groupBy("qid").agg(F.collect_list(F.struct("position", "similarity")).alias("pairs")), "qid")

    def count(block: list) -> DataFrame:
        most = max(len(r["pairs"]) for r in block)
        at, marks = np.full((len(block), most), -1, np.int64), np.full((len(block), most), np.inf)
        for n, r in enumerate(block):
            at[n, : len(r["pairs"])], marks[n, : len(r["pairs"])] = [p["position"] for p in r["pairs"]], [round(p["similarity"], 9) for p in r["pairs"]]
        held = vectors.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in block]), np.array([r["vec"] for r in block], np.float64), at, marks))

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, at, marks = held.value
            total = np.zeros(at.shape, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = matrix @ _matrix(batch.column("vec"), batch.num_rows).T
                q, v = np.nonzero(scores >= (-np.inf if threshold is None else threshold))
                own, place = np.round(scores[q, v], 9), batch.column("position").to_numpy(zero_copy_only=False)[v]
                for j in range(at.shape[1]):
                    before = (own > marks[q, j]) | ((own == marks[q, j]) & (place < at[q, j]))
                    total[:, j] += np.bincount(q[before], minlength=len(ids))
            q, j = np.nonzero(at >= 0)
            yield pa.record_batch([pa.array(ids[q]), pa.array(at[q, j]), pa.array(total[q, j])], names=["qid", "position", "above"])

        return vectors.select("position", "vec").mapInArrow(above, f"qid {kind}, position long, above long")

    found = _over_blocks(wanted, ["qid", "vec", "pairs"], count, f"qid {kind}, position long, above long")
    return found.groupBy("qid", "position").agg(F.sum("above").alias("above"))
