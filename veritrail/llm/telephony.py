"""Telephony audio in media columns.

A media column holds WAV files of 8-bit mu-law or A-law samples, or of IMA ADPCM blocks,
at 8 kHz.  Companded samples expand by tables of 256 values, which are made from the
G.711 rule; ADPCM blocks are decoded by numpy, step by step over all blocks at once.
Decoded sound is resampled to ``PCM_RATE`` as 16-bit PCM.

Defined results: a null or empty payload is one block of padding; bytes that are no WAV
file of these kinds raise ValueError with the reason; a sound without samples has no PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import stored

ALAW, MULAW, IMA_ADPCM = 6, 7, 0x11
RATE, PCM_RATE = 8_000, 16_000
#: Payloads are padded with ``PAD`` to a multiple of ``FRAME`` bytes.
FRAME, PAD = 576, 255
#: The step sizes of IMA ADPCM and the moves of its step index.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int64,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


def mulaw_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes."""
    code = np.arange(256) ^ 0x55
    part, level = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, level + 8, (level + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of ``block`` bytes: a header of sample, index and zero, then low nibble first."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    if not len(blocks):
        return np.empty(0, np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).astype(np.int64)
    out = np.empty((len(blocks), nibbles.shape[1] + 1), np.int16)
    out[:, 0] = sample
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], IMA_STEPS[index]
        size = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        sample = np.clip(np.where(code & 8, sample - size, sample + size), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code], 0, 88)
        out[:, k + 1] = sample
    return out.ravel()


def wav(payload: bytes, kind: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file around stored samples; odd lengths get the pad byte that RIFF asks for."""
    bits = 4 if kind == IMA_ADPCM else 8
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if kind == IMA_ADPCM else struct.pack("<H", 0)
    per_second = rate * block // ((block - 4) * 2 + 1) if kind == IMA_ADPCM else rate
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Kind, rate, block size and stored samples of a WAV file."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(view):
        size = struct.unpack_from("<I", view, at + 4)[0]
        if view[at : at + 4] == b"fmt ":
            head = struct.unpack_from("<HHIIHH", view, at + 8)
        elif view[at : at + 4] == b"data":
            if head is None or head[0] not in (ALAW, MULAW, IMA_ADPCM) or head[1] != 1:
                raise ValueError("not mono mu-law, A-law or IMA ADPCM")
            if at + 8 + size > len(view):
                raise ValueError("the samples end early")
            return head[0], head[2], head[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file."""
    kind, rate, block, stored_ = read_wav(media)
    data = np.frombuffer(stored_, np.uint8)
    return (decode_adpcm(data, block) if kind == IMA_ADPCM else TABLES[kind][data]), rate


def resample(pcm: np.ndarray, rate: int, to: int = PCM_RATE) -> np.ndarray:
    """Linear interpolation at the new rate's instants, rounded half up."""
    if not len(pcm) or rate == to:
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:] + 1) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * to // rate
    return np.floor(np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm) + 0.5).astype(np.int16)


def features(pcm: np.ndarray, rate: int) -> str:
    """Duration, root mean square, peak, share of sign changes and checksum of 16-bit PCM."""
    if not len(pcm):
        return "ms=0 rms=0 peak=0 zcr=0.0000 crc=0"
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt((wide * wide).sum() / len(pcm)))
    negative = pcm < 0
    changes = int((negative[1:] != negative[:-1]).sum())
    return f"ms={len(pcm) * 1000 // rate} rms={rms} peak={int(np.abs(wide).max())} zcr={changes / len(pcm):.4f} crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def to_media(df: DataFrame, payload: str, output: str = "media", kind: int = MULAW) -> DataFrame:
    """Add a WAV file of each binary payload, padded to whole frames; a column named like the output is replaced."""

    @F.arrow_udf("binary")
    def write(column: pa.Array) -> pa.Array:
        return pa.array([wav(padded(v.as_py() or b""), kind) for v in column], pa.binary())

    return df.withColumn(output, write(F.col(payload)))


def with_pcm(df: DataFrame, media: str = "media", output: str = "pcm", rate: int = PCM_RATE) -> DataFrame:
    """Add 16-bit little-endian PCM of each WAV file at the given rate; null stays null."""

    @F.arrow_udf("binary")
    def expand(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else resample(*decode(v), rate).astype("<i2").tobytes() for v in column.to_pylist()], pa.binary())

    return df.withColumn(output, expand(F.col(media)))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text's bytes as mu-law sound, read the stored sound back and describe it (``DIGESTS``)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    kept = stored(to_media(source, "payload").select("doc_id", F.length("payload").cast("long").alias("n_bytes"), "media"), "telephony", compression="zstd")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, "media"):
                columns: list[list] = [[] for _ in range(6)]
                for value in batch.column("media"):
                    media = memoryview(value.as_buffer())
                    payload = read_wav(media)[3]
                    pcm, rate = decode(media)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(resample(pcm, rate), PCM_RATE))
                    for column, item in zip(columns, row):
                        column.append(item)
                yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, columns)], names=[f.split()[0] for f in DIGESTS.split(", ")])

    return kept.mapInArrow(describe, DIGESTS)
