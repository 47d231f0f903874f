"""Markdown corpora: listing, reading, chunking and the fingerprint of what was read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_documents

SUFFIXES = (".md", ".markdown")
#: What a corpus leaves out unless told otherwise.
EXCLUDED = (".*", "drafts/**", "_drafts/**", "exports/**", "*.tmp.md", "*~")
MANIFEST_VERSION = 3
#: Files whose bytes a task holds at once.
FILES_AT_ONCE = 16


def is_excluded(path: str, globs=EXCLUDED) -> bool:
    """Whether a path under the corpus matches a glob: as a whole, by any part if the glob has no slash, or below ``dir/**``."""
    parts = PurePosixPath(path).parts
    above = ["/".join(parts[: k + 1]) for k in range(len(parts) - 1)]
    for glob in (g.strip().replace("\\", "/") for g in globs):
        names = [path]
        if "/" not in glob:
            names += parts
        if glob and (any(fnmatch(n, glob) for n in names) or glob.endswith("/**") and any(fnmatch(n, glob[:-3]) for n in [*above, *parts[:-1]])):
            return True
    return False


def list_files(folder: str, globs=EXCLUDED) -> list[str]:
    """Sorted relative paths of the Markdown files below a folder; none if it is missing."""
    root = Path(folder)
    found = (p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and p.suffix.lower() in SUFFIXES)
    return sorted(p for p in found if not is_excluded(p, globs))


def read_files(spark: SparkSession, folder: str, globs=EXCLUDED) -> DataFrame:
    """(source_file, content, text) of a folder that driver and executors share.

    The driver lists names alone; tasks read the files.  Spark's own listing hides names
    that begin with ``_``, so paths are given.
    """
    names = spark.createDataFrame([(p,) for p in list_files(folder, globs)], "source_file string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, FILES_AT_ONCE):
                some = batch.slice(k, FILES_AT_ONCE)
                contents = [(Path(folder) / p).read_bytes() for p in some.column("source_file").to_pylist()]
                yield pa.record_batch([some.column("source_file"), pa.array(contents, pa.binary())], names=["source_file", "content"])

    files = names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, "source_file string, content binary")
    return files.withColumn("text", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""))


def load_chunks(files: DataFrame, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of all files with their ``position``: files in path order, chunks in file order.

    Positions follow from the chunks of each file and the sums of the files before; only
    a row a file meets in one task.
    """
    chunks = chunk_documents(files, max_chars, overlap_chars)
    sizes = chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("source_file", (F.sum("n").over(Window.orderBy("source_file")) - F.col("n")).alias("before"))
    return chunks.join(before, "source_file").withColumn("position", F.col("before") + F.col("ordinal")).drop("before")


def fingerprint(files: DataFrame) -> str:
    """A digest of all paths and contents, whatever the order of rows; of no files, that of an empty text.

    Each file's digest is taken where it is read.  Files meet in 4096 groups by the
    digest of their path, in path order, and the groups' digests in one row.
    """
    each = files.select("source_file", F.substring(F.sha2("source_file", 256), 1, 3).alias("group"), F.sha2("content", 256).alias("digest"))
    line = F.concat("source_file", F.lit("\0"), F.coalesce("digest", F.lit("")), F.lit("\n"))
    groups = each.groupBy("group").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("digest"))
    whole = groups.agg(F.sort_array(F.collect_list(F.concat("group", F.lit(" "), "digest", F.lit("\n")))).alias("lines"))
    return whole.select(F.sha2(F.array_join("lines", ""), 256).alias("digest")).first().digest


def manifest(files: DataFrame, chunks: DataFrame, model: str, dimension: int, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> dict:
    names = chunks.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("source_file")).alias("files")).first()
    return {
        "schema_version": MANIFEST_VERSION, "fingerprint": fingerprint(files), "chunks": names.n, "dimension": dimension, "embedding_model": model,
        "source_files": names.files, "chunk_max_chars": max_chars, "chunk_overlap_chars": overlap_chars,
    }


def save_index(chunks: DataFrame, vectors: DataFrame, folder: str, described: dict) -> bool:
    """Write chunks and vectors under the fingerprint's name, then the manifest that points to them; an empty index is not written."""
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows, width, least, bad = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.size("vec")), F.count_if(F.coalesce(broken, F.lit(True)))).first()
    if not described["chunks"]:
        return False
    if rows != described["chunks"] or width != described["dimension"]:
        raise ValueError("the manifest disagrees with the vectors")
    if least != width or bad:
        raise ValueError("vectors must be of one width and finite")
    chunks.write.mode("overwrite").parquet(f"{folder}/v={described['fingerprint']}/chunks")
    vectors.write.mode("overwrite").parquet(f"{folder}/v={described['fingerprint']}/vectors")
    fresh = Path(folder) / "manifest.json.new"
    fresh.write_text(json.dumps(described, indent=2, ensure_ascii=False), encoding="utf-8")
    fresh.replace(Path(folder) / "manifest.json")
    return True


def load_index(spark: SparkSession, folder: str, expected: dict) -> tuple[DataFrame, DataFrame] | None:
    """Chunks and vectors if the stored manifest equals what is expected, else None: the index must be built anew."""
    try:
        found = json.loads((Path(folder) / "manifest.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    keys = ("schema_version", "fingerprint", "dimension", "embedding_model", "chunk_max_chars", "chunk_overlap_chars")
    if not isinstance(found, dict) or any(found.get(k) != expected.get(k) for k in keys):
        return None
    at = f"{folder}/v={found['fingerprint']}"
    return spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/vectors")
