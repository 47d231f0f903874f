"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch are joined into one text, whose suffixes are sorted to
the depth of the longest piece.  Binary search finds for every piece the range of
suffixes that begin with it, so all its occurrences; these are the edges of the
segmentation graph.  Sorted by where they end, edges are relaxed: a prefix ends in the
one piece which can follow the last piece of what precedes it.  For byte-pair models two
pieces can stand side by side if merging never joins characters across their border.

Segments are cut where no piece of the vocabulary holds both neighbours, so they are
encoded alone without changing a result.

Defined results: a null or empty text has no ids; characters without a piece become byte
pieces, or the unknown piece in a model without them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .token_pack import PieceIds

SPACE = "▁"
_NEVER = np.iinfo(np.int64).max
#: Bytes of segments encoded at once, beyond which the edges of more would take hundreds of MB; a longer segment is encoded by itself.
ENCODED_BYTES = 1 << 18


def merge_pieces(symbols: list[str], rank: dict[str, tuple]) -> list[str]:
    """Byte-pair merging: again and again the best-ranked, then leftmost, pair of neighbours that is a piece."""
    left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    part: list[str | None] = list(symbols)
    queue = [(rank[a + b], k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0 and (r := rank.get(part[i] + part[right[i]])) is not None:
            heapq.heappush(queue, (r, i, part[i], part[right[i]]))

    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = right[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j], right[i] = a + b, None, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [p for p in part if p is not None]


class PieceModel:
    """A byte-pair model of the sentencepiece library, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models without normalisation are read")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        normal = [k for k, p in enumerate(spec.pieces) if p.type == 1]
        self.byte_ids = np.full(256, next(k for k, p in enumerate(spec.pieces) if p.type == 2), np.uint32)
        for k, p in enumerate(spec.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
        self.has_bytes = any(p.type == 6 for p in spec.pieces)
        self.ids = {self.pieces[k]: k for k in normal}
        self.rank = {self.pieces[k]: -spec.pieces[k].score for k in normal}
        self._bytes_of = [b"" if p.type in (2, 3) else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        self._lengths_of = np.array([len(b) for b in self._bytes_of])
        self._starts_of = np.cumsum(self._lengths_of) - self._lengths_of
        self._pool = np.frombuffer(b"".join(self._bytes_of), np.uint8)
        self._build()

    def _build(self) -> None:
        alphabet = sorted({c for p in self.ids for c in p})
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        code = {c: k + 2 for k, c in enumerate(alphabet)}  # 0 ends a segment, 1 is any other character
        neighbours = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.joins = np.zeros((128, 128), bool)
        for a, b in neighbours:
            a, b = " " if a == SPACE else a, " " if b == SPACE else b
            if ord(a) < 128 and ord(b) < 128:
                self.joins[ord(a), ord(b)] = True
        #: Spines: what a piece's first or last character becomes, step by step, and at which rank.
        n, deepest = len(self.pieces), 2
        lefts: dict[int, list[int]] = {}
        rights: dict[int, list[int]] = {}
        self.loops = np.zeros(n + 1, bool)  # pieces whose steps are not in order of rank
        matched: list[str] = []
        for p in sorted(self.ids, key=len):
            k = self.ids[p]
            if len(p) == 1:
                lefts[k] = rights[k] = [k]
                matched.append(p)
                continue
            steps, ordered = self._history(p)
            if steps is None:
                continue  # merging never makes this piece
            matched.append(p)
            lefts[k], rights[k] = steps
            self.loops[k] = not ordered
            deepest = max(deepest, len(lefts[k]), len(rights[k]))
        self.left_id, self.right_id = (np.full((n + 1, deepest), n, np.int64) for _ in range(2))
        self.left_rank, self.right_rank = (np.full((n + 1, deepest + 1), np.inf) for _ in range(2))
        for ids_, rank_, spines in ((self.left_id, self.left_rank, lefts), (self.right_id, self.right_rank, rights)):
            for k, spine in spines.items():
                ids_[k, : len(spine)] = spine
                rank_[k, : len(spine)] = [-np.inf, *(self.rank[self.pieces[s]] for s in spine[1:])]
        pairs = sorted((self.ids[p[:i]] * (n + 1) + self.ids[p[i:]], self.rank[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs])
        self.unknown = n
        self.match_ids = np.array([self.ids[p] for p in matched], np.int64)
        self.match_lengths = np.array([len(p) for p in matched], np.int64)
        self.depth = -(-int(self.match_lengths.max()) // 4)
        low = np.zeros((len(matched), 4 * self.depth), np.uint64)
        for k, p in enumerate(matched):
            low[k, : len(p)] = [code[c] for c in p]
        high = low.copy()
        high[np.arange(len(matched)), self.match_lengths - 1] += np.uint64(1)
        self.match_low, self.match_high = self._words(low), self._words(high)
        self.length_of = np.ones(n + 1, np.int64)
        self.length_of[self.match_ids] = self.match_lengths

    def _history(self, piece: str):
        """The spines by which merging builds a piece from its characters, and whether ranks rise along them; None if it never does."""
        part, first, last, ordered = list(piece), [piece[0]], [piece[-1]], True
        while len(part) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.rank), default=None)
            if best is None:
                return None, False
            k = best[1]
            merged = part[k] + part[k + 1]
            ordered &= all(len(x) == 1 or self.rank[x] < best[0] for x in part[k : k + 2])
            part[k : k + 2] = [merged]
            if k == 0:
                first.append(merged)
            if k == len(part) - 1:
                last.append(merged)
        return ([self.ids[x] for x in first], [self.ids[x] for x in last]), ordered

    @staticmethod
    def _words(codes: np.ndarray) -> list[np.ndarray]:
        """Rows of 16-bit codes as columns of 64-bit words, four codes each, that order as the codes do."""
        return [codes[:, k] << np.uint64(48) | codes[:, k + 1] << np.uint64(32) | codes[:, k + 2] << np.uint64(16) | codes[:, k + 3] for k in range(0, codes.shape[1], 4)]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between two pieces alone, followed step by step on both sides."""
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        while len(live):
            u, t = left[live], right[live]
            key = self.right_id[u, i] * (self.unknown + 1) + self.left_id[t, j]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.inf)
            next_u, next_t = self.right_rank[u, i + 1], self.left_rank[t, j + 1]
            broken = (rank < next_u) & (rank <= next_t) & (rank < np.inf)
            good[live[broken]] = False
            on = ~broken & (np.minimum(next_u, next_t) < np.inf)
            step = next_u[on] <= next_t[on]
            live, i, j = live[on], i[on] + step, j[on] + ~step
        return good

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a piece in the text: its start and its number in ``match_ids``."""
        padded = np.concatenate([codes, np.zeros(4 * self.depth, np.uint64)])
        columns = [padded[k : k + len(codes)] for k in range(4 * self.depth)]
        keys = [columns[k] << np.uint64(48) | columns[k + 1] << np.uint64(32) | columns[k + 2] << np.uint64(16) | columns[k + 3] for k in range(0, 4 * self.depth, 4)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        bounds = [self._search(keys, wanted) for wanted in (self.match_low, self.match_high)]
        found = bounds[1] - bounds[0]
        return suffixes[tb.gather_ragged(np.arange(len(suffixes)), bounds[0], found)], np.repeat(np.arange(len(found)), found)

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
        """For each wanted row the first suffix not before it."""
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        first = np.searchsorted(keys[0], wanted[0], "left")
        last = np.searchsorted(keys[0], wanted[0], "right")
        low, high = first, last  # all earlier words equal between them
        for key, want in zip(keys[1:], wanted[1:]):
            todo = np.flatnonzero(high > low)
            lo, hi = low[todo].copy(), high[todo].copy()
            lo2, hi2 = lo.copy(), hi.copy()
            target = want[todo]
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = open_ & (key[np.minimum(mid, len(key) - 1)] < target)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            while (open_ := lo2 < hi2).any():
                mid = (lo2 + hi2) // 2
                less = open_ & (key[np.minimum(mid, len(key) - 1)] <= target)
                lo2, hi2 = np.where(less, mid + 1, lo2), np.where(open_ & ~less, mid, hi2)
            low[todo], high[todo] = lo, lo2
        return low

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments (spaces as spaces), joined, and how many each has."""
        ends = np.cumsum([0, *map(len, segments)])
        parts, at = [], 0
        while at < len(segments) or not parts:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENCODED_BYTES, "right")) - 1)
            parts.append(self._encode(segments[at:to]))
            at = to
        return tuple(map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0]

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        between = b"\xff\xff\xff\xff"  # no character
        text = b"".join([x for s in segments for x in (s.decode().replace(" ", SPACE).encode("utf-32-le"), between)])
        points = np.frombuffer(text, np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == points, at + 2, 1).astype(np.uint64)
        border = points == 0xFFFFFFFF
        codes[border] = 0
        ends = np.flatnonzero(border)
        begins = np.concatenate([[0], ends[:-1] + 1])
        start, which = self.occurrences(codes)
        length, piece = self.match_lengths[which], self.match_ids[which]
        strange = np.flatnonzero(codes == 1)
        start, length = np.concatenate([start, strange]), np.concatenate([length, np.ones(len(strange), np.int64)])
        piece = np.concatenate([piece, np.full(len(strange), self.unknown)])
        segment_of = np.repeat(np.arange(len(ends)), ends - begins + 1)
        odd = np.zeros(len(ends), bool)
        odd[segment_of[start[self.loops[piece]]]] = True
        kept = ~odd[segment_of[start]]
        start, length, piece = start[kept], length[kept], piece[kept]
        last = self._relax(start, length, piece, begins[segment_of], len(points))
        return self._assemble(segments, points, last, begins, ends, odd)

    def _relax(self, start: np.ndarray, length: np.ndarray, piece: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """For each place the piece that ends there in the encoding of its segment up to that place; -1 if none does."""
        depth = start + length - begin[start]
        order = np.argsort(depth, kind="stable")
        start, length, piece, depth = start[order], length[order], piece[order], depth[order]
        first = start == begin[start]
        steps = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        last = np.full(n + 1, -1, np.int64)
        for a, b in zip(steps[:-1], steps[1:]):
            own, before = slice(a, b), np.where(first[a:b], 0, last[start[a:b] - 1])
            fits = first[own] | (before >= 0)
            inner = np.flatnonzero(fits & ~first[own])
            fits[inner] = self._compatible(before[inner], piece[own][inner])
            last[(start[own] + length[own] - 1)[fits]] = piece[own][fits]
        return last

    def _assemble(self, segments, points, last, begins, ends, odd) -> tuple[np.ndarray, np.ndarray]:
        taken_at, taken = [], []
        at = ends[~odd & (ends > begins)] - 1
        low = begins[~odd & (ends > begins)]
        while len(at):
            piece = last[at]
            taken_at.append(at)
            taken.append(piece)
            at = at - self.length_of[piece]
            more = at >= low
            at, low = at[more], low[more]
        place = np.concatenate([*taken_at, np.empty(0, np.int64)])
        piece = np.concatenate([*taken, np.empty(0, np.int64)])
        order = np.argsort(place)
        place, piece = place[order], piece[order]
        segment = np.searchsorted(ends, place)
        ids, counts = piece.astype(np.uint32), np.ones(len(piece), np.int64)
        strange = np.flatnonzero(piece == self.unknown)
        if len(strange) or odd.any():
            spelled = {int(k): self._spell(chr(points[place[k]])) for k in strange}
            out, extra = [], {int(k): self._merge_alone(segments[k]) for k in np.flatnonzero(odd)}
            starts = np.searchsorted(segment, np.arange(len(ends) + 1))
            lengths = np.zeros(len(ends), np.int64)
            touched = {*extra, *segment[strange].tolist()}
            at = 0
            for k in sorted(touched):
                out.append(ids[at : starts[k]])
                mine = extra[k] if k in extra else [i for x in range(starts[k], starts[k + 1]) for i in (spelled[x] if x in spelled else (ids[x],))]
                out.append(np.array(mine, np.uint32))
                lengths[k] = len(mine)
                at = starts[k + 1]
            out.append(ids[at:])
            plain = np.ones(len(ends), bool)
            plain[list(touched)] = False
            lengths[plain] = np.diff(starts)[plain]
            return np.concatenate(out), lengths
        return ids, np.bincount(segment, minlength=len(ends))

    def _spell(self, c: str) -> list[int]:
        return self.byte_ids[list(c.encode())].tolist() if self.has_bytes else [int(self.byte_ids[0])]

    def _merge_alone(self, segment: bytes) -> list[int]:
        parts = merge_pieces(list(segment.decode().replace(" ", SPACE)), self.rank)
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else self._spell(p))]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tb.Segments:
        """Texts cut between neighbouring ASCII characters that no piece holds side by side."""
        before = np.zeros(len(data), bool)
        both = (data[1:] < 128) & (data[:-1] < 128)
        before[1:] = both & ~self.joins[data[:-1] & 127, data[1:] & 127]
        return tb.cut(data, offsets, before)

    def prefixed(self, column: pa.Array) -> pa.Array:
        """Texts with the space that the model puts before those that are not empty."""
        column = column.fill_null("")
        if not self.dummy_prefix:
            return column
        return pa.compute.if_else(pa.compute.equal(column, ""), "", pa.compute.binary_join_element_wise(pa.scalar(" "), column, ""))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids, without the space that encoding put before it."""
        lengths = self._lengths_of[ids]
        data = tb.gather_ragged(self._pool, self._starts_of[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        skip = 1 if self.dummy_prefix else 0
        return [data[a + (skip if data[a : a + 1] == b" " else 0) : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _model(path: str) -> tuple[PieceModel, PieceIds]:
    def read() -> tuple[PieceModel, PieceIds]:
        model = PieceModel(path)
        return model, PieceIds(model.encode_segments)

    return tb.only(f"pieces {path}", read)


def encode_batch(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of texts, joined, and how many each text has."""
    model, ids = _model(path)
    return ids.of(model.segments(*tb.text_bytes(model.prefixed(column))))


def with_pieces(df: DataFrame, path: str, text: str = "text", output: str = "pieces") -> DataFrame:
    """Add the ids of each whole text.  ``path`` is a model file that every executor has."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        parts = []
        for part in tb.slices(pa.record_batch([column], ["t"]), "t"):
            ids, counts = encode_batch(path, part.column(0))
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(output, encode(F.coalesce(F.col(text), F.lit(""))))


def with_decoded(df: DataFrame, path: str, pieces: str = "pieces", output: str = "decoded") -> DataFrame:
    """Add the text that ids stand for; bytes that are no UTF-8 become replacement characters; null ids are an empty text."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        counts = np.asarray(pa.compute.list_value_length(column).fill_null(0), dtype=np.int64)
        ids = np.asarray(column.flatten(), dtype=np.int64)
        return pa.array([b.decode("utf-8", "replace") for b in _model(path)[0].decode(ids, counts)], pa.string())

    return df.withColumn(output, decode(F.col(pieces)))


def round_trips(docs: DataFrame, path: str, digest, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass; ``digest`` (doc ids, texts, ids, counts, decoded bytes) gives the columns of ``schema``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "text"):
                ids, counts = encode_batch(path, batch.column("text"))
                decoded = _model(path)[0].decode(ids.astype(np.int64), counts)
                yield pa.record_batch(digest(batch.column("doc_id"), batch.column("text"), ids, counts, decoded), names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(work, schema)
