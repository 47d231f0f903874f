"""Merkle manifest of a dataset: a tree of digests a group, proofs for every row, verification.

The leaves of a group stand in order; every ``ARITY`` consecutive nodes become their
parent, level by level, until one is left.  The groups' roots are the leaves of one more
tree.  A leaf knows its index and the number of leaves of its group, so the number of
children of every parent follows from sizes alone.

Parents are built by events, as a combineByKey over partitions: a digest that arrives is
put into its partial parent by index; the parent that has all children turns into a digest
and arrives at its own parent at once.  What a partition cannot finish is its frontier, a
few partial parents a level because leaves lie in order; only the frontier is shuffled, by
ancestors ``SPAN`` levels up, and merged by the same rule until nothing is left.  Finished
parents keep their children: these reverse links give each node's siblings, and paths are
joined from the root down to the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, stored

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels that one shuffle of the frontier finishes: a task's key then has at most ARITY**SPAN digests.
SPAN = 4
#: Parents of a level whose paths (siblings up to the root) may be broadcast.
BROADCAST_PATHS = 4096

NODE = "tree string, n long, level int, i long, digest string, children array<string>, resolved boolean"
STEP = "array<struct<before:string,after:string>>"


def row_digest(*columns: Column) -> Column:
    """SHA-256 of values in order, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``n``, the leaves of a row's ``tree``, and ``i``, its place among them by ``order`` (nulls first).

    Rows are dealt by ranges and numbered inside each part; a part's offset is the sum of
    the parts before it, so no task counts a whole tree.  Rows equal in ``order`` keep the
    order of the input.
    """
    tied = stored(leaves.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")  # the ranges are found by a pass of their own
    keys = ["tree", *order, "_tie"]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("_at", 33).alias("_part")
    runs = placed.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    runs = stored(runs, "merkle-runs")
    numbered = placed.withColumn("_part", part).join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, ["tree", "_part"])
    return numbered.withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_first", "_before", "_at")


class Parents:
    """Partial parents of one task, by tree, level and index."""

    def __init__(self) -> None:
        self.partial: dict[tuple, list] = {}
        self.done: list[tuple] = []

    def arrive(self, tree: str, n: int, level: int, i: int, digest: str) -> None:
        """Put a node into its parent, and on, as long as parents become complete."""
        below = -(-n >> ARITY_BITS * level)  # nodes of this level
        while below > 1:
            key = (tree, level + 1, i >> ARITY_BITS)
            children = self.partial.get(key)
            if children is None:
                arity = min(ARITY, below - (i >> ARITY_BITS << ARITY_BITS))
                children = self.partial[key] = [n, arity, [None] * arity]
            children[2][i & (ARITY - 1)] = digest
            children[1] -= 1
            if children[1]:
                return
            del self.partial[key]
            digest = hashlib.sha256("".join(children[2]).encode()).hexdigest()
            level, i, below = level + 1, i >> ARITY_BITS, -(-below >> ARITY_BITS)
            self.done.append((tree, n, level, i, digest, children[2], True))

    def frontier(self) -> list[tuple]:
        return [(tree, n, level, i, None, children, False) for (tree, level, i), (n, _, children) in self.partial.items()]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and partial parents to resolved parents and the partial ones that are left."""
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("resolved", pa.bool_())])
    parents = Parents()
    for batch in batches:
        for tree, n, level, i, digest, children, _ in zip(*(batch.column(f.name).to_pylist() for f in schema)):
            if children is None:
                parents.arrive(tree, n, level, i, digest)
            else:
                for k, child in enumerate(children):
                    if child is not None:
                        parents.arrive(tree, n, level - 1, (i << ARITY_BITS) + k, child)
        if parents.done:
            yield _arrow(parents.done, schema)
            parents.done = []
    if parents.partial:
        yield _arrow(parents.frontier(), schema)


def parents(leaves: DataFrame, most: int) -> DataFrame:
    """(tree, n, level, i, digest, children) of every parent over leaves (tree, n, i, digest) of at most ``most`` a tree."""
    wide = leaves.select("tree", "n", F.lit(0).alias("level"), "i", "digest", F.lit(None).cast("array<string>").alias("children"), F.lit(False).alias("resolved"))
    climbed = stored(wide.mapInArrow(_climb, NODE), "merkle-nodes")
    found, top = climbed.filter("resolved"), 0
    while ARITY ** top < most:
        top += SPAN
        left = climbed.filter("not resolved")
        keyed = left.withColumn("_block", F.expr(f"shiftright(i, greatest({top} - level, 0) * {ARITY_BITS})"))
        climbed = stored(keyed.repartition("tree", "_block").drop("_block").mapInArrow(_climb, NODE), "merkle-nodes")
        found = found.unionByName(climbed.filter("resolved"))
    return found.drop("resolved")


def _beside(children: Column, at: Column) -> Column:
    """The siblings before and after a child, joined; none for a node that is left alone."""
    before, after = F.array_join(F.slice(children, 1, at), ""), F.array_join(F.slice(children, at + 2, ARITY), "")
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def paths(nodes: DataFrame, tops: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What leads from the parents of leaves, and from each lone leaf, to the root.

    ``tops`` has (tree, n, subroot, root, path) with the steps from the top of a tree on.
    The first result has (tree, i, children, path, subroot, root) for parents of leaves,
    the second the rows of ``tops`` whose tree is one leaf.
    """
    height = 0
    while ARITY ** height < most:
        height += 1
    own = ["tree", "path", "subroot", "root"]
    tall = F.lit(0)
    for level in range(height):  # the level of a tree's top: how often its size is divided
        tall = tall + (F.col("n") > F.lit(ARITY ** level)).cast("int")
    tops = tops.withColumn("_top", tall)
    nodes = stored(nodes, "merkle-parents")
    counts = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # one row a level
    above = None
    for level in range(height, 0, -1):
        starts = tops.filter(F.col("_top") == level).select(*own, F.lit(0).cast("long").alias("i"))
        if above is not None:
            children = above.select(*own, "i", "children", F.posexplode("children").alias("k", "_child"))
            lower = children.select("tree", F.concat(_beside(F.col("children"), F.col("k")), "path").alias("path"), "subroot", "root", (F.col("i") * ARITY + F.col("k")).alias("i"))
            starts = starts.unionByName(lower)
        here = nodes.filter(F.col("level") == level).select("tree", "i", "children")
        small = counts.get(level, 0) <= BROADCAST_PATHS
        above = here.join(F.broadcast(starts) if small else starts, ["tree", "i"])
        if small and level > 1:
            above = stored(above, "merkle-paths")
    return above, tops.filter("_top = 0")


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda now, step: F.sha2(F.concat(step["before"], now, step["after"]), 256))


def _with_paths(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, most: int) -> DataFrame:
    """Add ``path``, ``subroot`` and ``root`` to leaves (tree, n, i, digest, ...)."""
    under, lone = paths(nodes, tops, most)
    lone = lone.select("tree", "path", "subroot", "root")
    single = leaves.filter("n = 1").join(lone, "tree")
    if under is None:
        return single
    at = F.pmod("i", F.lit(ARITY)).cast("int")
    many = leaves.filter("n > 1").withColumn("_p", F.floor(F.col("i") / ARITY)).join(under.withColumnRenamed("i", "_p"), ["tree", "_p"])
    many = many.withColumn("path", F.concat(_beside(F.col("children"), at), "path")).drop("_p", "children")
    return many.unionByName(single.select(many.columns))


def with_proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to leaves (tree, digest, and columns to order by).

    ``path`` holds the siblings before and after each node from the leaf to the root.
    ``tree`` names a group by a text that is not null; groups are ordered by it bytewise.
    """
    placed = stored(indexed(leaves, order), "merkle-indexed")
    most = placed.agg(F.max("n")).first()[0] or 0
    nodes = parents(placed, most)
    ends = nodes.groupBy("tree").agg(F.first("n").alias("n"), F.max_by("digest", "level").alias("subroot"))
    lone = placed.filter("n = 1").select("tree", "n", F.col("digest").alias("subroot"))
    subroots = stored(ends.unionByName(lone), "merkle-subroots")
    above = stored(indexed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("n").alias("size"), F.col("subroot").alias("digest")), ["own"]), "merkle-indexed")
    trees = above.agg(F.max("n")).first()[0] or 0
    joined = stored(parents(above, trees), "merkle-parents")
    last = joined.unionByName(above.filter("n = 1").select("tree", "n", F.lit(0).alias("level"), "i", "digest", F.lit(None).cast("array<string>").alias("children")))
    root = last.orderBy(F.desc("level")).limit(1).select("tree", "n", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    tops = _with_paths(above, joined, root, trees).select(F.col("own").alias("tree"), F.col("size").alias("n"), F.col("digest").alias("subroot"), "root", "path")
    return _with_paths(placed, nodes, stored(tops, "merkle-tops"), most)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", doc_id: str = "doc_id", other: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, other): the digest of each row with its way to the dataset's root.

    Rows are grouped by ``group`` (null first, then bytewise) and stand by ``doc_id``
    (null first).  ``other`` is a digest to carry along, such as that of a changed row.

    Defined results: nulls in any column count as ``-``; an empty text is ``0:``; equal
    ids stand by their leaves, and repeated rows are leaves of their own; an empty table
    has no rows; columns not named are not read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = row_digest(*(F.col(c) for c in columns))
    leaves = docs.select(tree.alias("tree"), F.col(doc_id).alias("doc_id"), leaf.alias("digest"), (leaf if other is None else other).alias("other"))
    return with_proofs(leaves, ["doc_id", "digest"]).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "other")


def proof_text(path: Column) -> Column:
    """All siblings of a path in order, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
