"""Token ids in fixed-width bit packing.

A packed run holds the ids of consecutive documents: a header, the documents' ids and
the starts of their tokens, the byte offset of every block of ``BLOCK_IDS`` ids, and the
blocks, in which each id takes as many bits as the vocabulary needs.  Any range of ids is
unpacked from its blocks alone.  Runs are rows of a Parquet table, which Spark commits
whole to any store; run r of shard s holds smaller document ids than run r + 1, and shard
s smaller ones than shard s + 1.

Texts are cut where a non-space is followed by white space, which every pre-tokenizer of
this kind takes for a boundary, and, where the file's own rules allow it, between letters
and marks, so equal pieces of text are encoded once by a worker.

Defined results: a null or empty text has the end id alone; repeated ids are kept, ordered
by text; a null id sorts first; an empty table has no runs.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import BROADCAST_ROWS, stored

MAGIC = b"TPK1"
BLOCK_IDS = 4096
#: Bytes that a worker's cache of pieces may hold.
CACHE_BYTES = 160 << 20
_HEAD = struct.Struct("<4sBxxxIQQ")
_NO_ID = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    """The bits that ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def pack_run(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """A run of documents; ``starts`` has one entry more than documents."""
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


@dataclass
class Run:
    """A packed run, of which only what is asked for is unpacked."""

    data: memoryview

    def __post_init__(self):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids = _HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a packed run")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        self._at = at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the run."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        out = []
        for k in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(self.data[self._at + self.offsets[k] : self._at + self.offsets[k + 1]], n, self.bits))
        return np.concatenate(out)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _other_space_ends(data: np.ndarray) -> np.ndarray:
    """Where a white-space character beyond ASCII ends."""
    out = np.zeros(len(data), bool)
    if (data == 0xC2).any():
        out[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        wide |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[2:] |= wide
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_ends(tokenizer: dict) -> np.ndarray | None:
    """By two neighbouring ASCII characters, whether a byte-level pre-tokenizer's words always part there; None if its file has other rules.

    A letter ends its word before any other character, and a mark but the apostrophe ends
    its run before a letter.  No added token is cut.
    """
    rule, added = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("added_tokens") or []
    if rule.get("type") != "ByteLevel" or not rule.get("use_regex", True) or rule.get("add_prefix_space", True) or tokenizer.get("normalizer"):
        return None
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        return None
    letter = np.array([chr(c).isalpha() for c in range(128)])
    mark = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(128)])
    out = letter[:, None] & mark[None, :] | (mark & (np.arange(128) != ord("'")))[:, None] & letter[None, :]
    for t in added:
        inside = t["content"].encode()
        for a, b in zip(inside, inside[1:]):
            if a < 128 and b < 128:
                out[a, b] = False
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray | None = None) -> tb.Segments:
    """Texts cut before each white space that follows a character which is none, and between characters for which ``ends`` holds."""
    space = _SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = space[1:] & ~space[:-1] & ~_other_space_ends(data)[:-1]
    if ends is not None:
        before[1:] |= (data[1:] < 128) & (data[:-1] < 128) & ends[data[:-1] & 127, data[1:] & 127]
    return tb.cut(data, offsets, before)


class PieceIds:
    """Ids of texts, encoded piece by piece, each distinct piece once while it is held."""

    def __init__(self, encode_pieces, limit: int = tb.CACHE_BYTES):
        self._encode = encode_pieces
        self._pool = np.empty(1 << 16, np.uint32)
        self._used = 0
        self._cache = tb.SegmentCache(self._make, limit, extra=lambda: 4 * self._used)

    def _make(self, new: list[bytes]) -> np.ndarray:
        if not self._cache.held():
            self._used = 0
        flat, lengths = self._encode(new)
        if self._used + len(flat) > len(self._pool):
            grown = np.empty(2 * (self._used + len(flat)), np.uint32)
            grown[: self._used] = self._pool[: self._used]
            self._pool = grown
        self._pool[self._used : self._used + len(flat)] = flat
        starts = self._used + np.cumsum(lengths) - lengths
        self._used += len(flat)
        return np.stack([starts, lengths], 1)

    def of(self, seg: tb.Segments) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each row has."""
        n = len(seg.per_row)
        if not len(seg.starts):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        codes, places = self._cache.find(seg)
        starts, lengths = places[codes, 0], places[codes, 1]
        return tb.gather_ragged(self._pool, starts, lengths), np.bincount(seg.rows, lengths, n).astype(np.int64)


def _encoder(path: str) -> tuple[PieceIds, np.ndarray | None]:
    def read() -> tuple[PieceIds, np.ndarray | None]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in tokenizer.encode_batch_fast([b.decode() for b in new], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

        with open(path, encoding="utf-8") as f:
            ends = word_ends(json.load(f))
        return PieceIds(encode, CACHE_BYTES), ends

    return tb.only(f"tokens {path}", read)


def pack_documents(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", name: str = "token-runs") -> DataFrame:
    """Encode and write all texts in ascending order of id; the stored (shard, run, n_ids, packed).

    ``tokenizer`` is the path of a byte-level BPE file that every executor has.
    """
    bits = bits_for(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, runs = TaskContext.get().partitionId(), count()
        encoder, ends = _encoder(tokenizer)
        for whole in batches:
            for batch in tb.slices(whole, "text"):
                if not batch.num_rows:
                    continue
                flat, lengths = encoder.of(pieces(*tb.text_bytes(batch.column("text")), ends))
                starts = np.concatenate([[0], np.cumsum(lengths + 1)])
                ids = np.full(starts[-1], end_id, np.uint32)
                inner = np.ones(len(ids), bool)
                inner[starts[1:] - 1] = False
                ids[inner] = flat
                doc_ids = np.asarray(batch.column("doc_id").fill_null(_NO_ID))
                packed = pack_run(ids, doc_ids, starts, bits)
                yield pa.record_batch(
                    [pa.array([shard], pa.int32()), pa.array([next(runs)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([packed], pa.binary())],
                    names=["shard", "run", "n_ids", "packed"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(encode, "shard int, run int, n_ids long, packed binary"), name, compression="zstd")


def read_documents(runs: DataFrame, measure, schema: str) -> DataFrame:
    """Unpack every run and apply ``measure`` (run, ids before it) -> list of arrays by the columns of ``schema``.

    The ids before a run are the sums of the shards before it and of its shard's runs
    before it; only those sums, a row a shard, meet in one task.
    """
    sizes = runs.select("shard", "run", "n_ids")
    inside = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("run")) - F.col("n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.withColumn("outside", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "outside")
    before = inside.join(F.broadcast(shards), "shard").select("shard", "run", (F.col("inside") + F.col("outside")).alias("before"))
    if sizes.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, ahead in zip(batch.column("packed"), batch.column("before").to_pylist()):
                yield pa.record_batch(measure(Run(memoryview(packed.as_buffer())), ahead), names=[f.split()[0] for f in schema.split(", ")])

    return runs.join(before, ["shard", "run"]).select("packed", "before").mapInArrow(read, schema)


def document_ids(values: np.ndarray) -> pa.Array:
    """Document ids of a run as an array, with its nulls."""
    return pa.array(values, mask=values == _NO_ID)
