"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A batch of texts is one byte array plus offsets.  Cutting it into segments and grouping
equal ones are whole-array operations, so the cost a byte does not depend on how the
bytes are divided into rows.  Segments are told apart by their bytes, never by a hash.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute

#: Bytes of text handled at once; the working arrays take about forty times as much.
SLICE_BYTES = 1 << 20
#: Bytes that a worker's cache of segments may hold, and what a held segment takes beside its own bytes and values.
CACHE_BYTES, _ENTRY_BYTES = 24 << 20, 150


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc keeps freed memory until it is told


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others and the executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``max_rows`` rows and ``max_bytes`` of text; a longer text is a run by itself.

    After the last of several runs, what they took is given back.
    """
    lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = min(at + max_rows, max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right"))))
        yield batch.slice(at, to - at)
        if to == len(ends) and at:
            give_back()
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without its nulls' contents, and the offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


class Segments:
    """Segments of a byte array: starts, ends and the row of each; ``body`` has their bytes joined."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.body, self.starts, self.ends = body, starts, ends
        first = np.searchsorted(starts, offsets)
        self.per_row = np.diff(first)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.per_row)

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """For each segment the number of its distinct segment, and the distinct segments in order of appearance."""
        if not len(self.starts):
            return np.empty(0, np.int64), []
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        joined = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.body))])
        coded = joined.dictionary_encode()
        return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def words(data: np.ndarray, offsets: np.ndarray) -> Segments:
    """The words of texts whose words are set apart by single or repeated spaces."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 32
    edge = inside[1:] != inside[:-1]
    begins = edge & inside[1:]
    stops = edge & inside[:-1]
    both = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] > 0)]
    both = both[inside[both + 1] & inside[both]]  # rows that touch without a space
    begins[both] = True
    stops[both] = True
    return Segments(data[data != 32], offsets, np.flatnonzero(begins), np.flatnonzero(stops))


def cut(data: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> Segments:
    """Cut every row before each byte at which ``before`` holds; no byte is lost."""
    before = before.copy()
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(before)
    return Segments(data, offsets, starts, np.append(starts[1:], len(data)))


class SegmentCache:
    """Rows of values by segment, made once for each distinct segment that a worker holds.

    ``make`` gets the distinct new segments as bytes and returns an array with a row for
    each.  When more than ``limit`` bytes are held, all are forgotten and made on demand;
    ``extra`` tells how many bytes ``make`` keeps elsewhere.
    """

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], limit: int = CACHE_BYTES, extra: Callable[[], int] = lambda: 0):
        self._make, self._limit, self._extra = make, limit, extra
        self._at: dict[bytes, int] = {}
        self._pool: np.ndarray | None = None
        self._bytes = 0

    def held(self) -> int:
        return len(self._at)

    def find(self, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the number of its distinct segment, and the row of values of each number."""
        codes, unique = segments.distinct()
        if self._bytes + self._extra() > self._limit:
            self._at, self._pool, self._bytes = {}, None, 0
        get = self._at.get
        places = np.fromiter((get(s, -1) for s in unique), np.int64, len(unique))
        new = np.flatnonzero(places < 0)
        if len(new) or self._pool is None:
            fresh = [unique[k] for k in new.tolist()]
            made = self._make(fresh)
            base = len(self._at)
            if self._pool is None or base + len(new) > len(self._pool):
                grown = np.empty((max(1 << 10, base + base // 4 + 2 * len(new)), *made.shape[1:]), made.dtype)
                if base:
                    grown[:base] = self._pool[:base]
                self._pool = grown
            self._pool[base : base + len(new)] = made
            places[new] = np.arange(base, base + len(new))
            self._at.update(zip(fresh, range(base, base + len(new))))
            self._bytes += sum(map(len, fresh)) + len(fresh) * _ENTRY_BYTES + made.nbytes
        return codes, self._pool[places]


def _digests(segments: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(s, digest_size=8).digest() for s in segments), "<u8").astype(np.uint64)


_large: dict[str, object] = {}


def only(key: str, make: Callable[[], object]):
    """The one large object (a model with its cache, or a cache) that a worker process holds; asking for another frees it."""
    if key not in _large:
        _large.clear()
        gc.collect()
        give_back()
        _large[key] = make()
        give_back()
    return _large[key]


def hashes(segments: Segments) -> np.ndarray:
    """A 64-bit BLAKE2b digest of each segment, which every worker gives alike."""
    if not len(segments.starts):
        return np.empty(0, np.uint64)
    codes, values = only("hashes", lambda: SegmentCache(_digests)).find(segments)
    return values[codes]


def gather_ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[s:s+n]`` for all pairs of ``starts`` and ``lengths``."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[np.arange(total) + shift]
