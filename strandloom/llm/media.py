"""Media columns: bytes kept as WAV samples, read back by the wave module, with spectral-peak fingerprints.

Each payload is padded with zero bytes to a positive multiple of 64 and stored, without loss, as 8-bit mono samples of a
WAV file in a binary column. The stored table is written to the shared folder and read back; from what is read come the
payload again, a short-time Fourier transform (Hann window of 32 samples, step 8, so that the shortest payload has five frames) of the differences between neighbouring samples, whose level would outweigh all else, and a fingerprint: the strongest
bin of each frame is a peak, each peak is paired with those of the next three frames, and a pair is a number made of both
bins and their distance, kept together with the frame at which it starts.

Frames are transformed in blocks, so a long payload needs no more working memory than a block. Both passes are narrow:
no shuffle, one row in, one row out, so any skew between keys has no effect.

Nulls: a null text is empty and gives one block of 64 zero bytes; a null doc_id stays null. Equal texts give equal values, repeated rows
a row each; of equal peaks of a frame the lowest bin counts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, utf8, written

UNIT, RATE, FRAME, STEP, AHEAD, BLOCK = 64, 8000, 32, 8, 3, 65536
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file of the payload, padded with zero bytes to a positive multiple of 64."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT)))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def differences(samples: np.ndarray) -> np.ndarray:
    """Each sample less the one before, with 128 as silence."""
    return np.diff(samples.astype(np.int16), prepend=samples[:1].astype(np.int16)) + np.int16(128)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin, the constant one apart, of every frame; the last frame is padded with silence."""
    n = max(1, -(-(len(samples) - FRAME) // STEP) + 1)
    found = np.empty(n, dtype=np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = np.full((hi - lo - 1) * STEP + FRAME, 128, dtype=np.float32)
        own = samples[lo * STEP : lo * STEP + len(part)]
        part[: len(own)] = own
        frames = np.lib.stride_tricks.sliding_window_view(part - 128, FRAME)[::STEP]
        z = np.fft.rfft(frames * _WINDOW, axis=1)[:, 1:]
        found[lo:hi] = np.argmax(z.real**2 + z.imag**2, axis=1) + 1
    return found


def fingerprint(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and pair numbers, ordered by time and distance."""
    n = len(found)
    code = np.full((n, AHEAD), -1, dtype=np.int32)
    for d in range(1, min(AHEAD, n - 1) + 1):
        code[: n - d, d - 1] = found[: n - d] << 14 | found[d:] << 4 | d
    there = code >= 0
    return np.repeat(np.arange(n, dtype=np.int32), there.sum(1)), code[there]


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the WAV file of each whole text."""

    bounded(docs.sparkSession)
    def stored(batches):
        for b in batches:
            at, data = utf8(b.column("text"))
            for lo in range(0, b.num_rows, 256):
                hi = min(b.num_rows, lo + 256)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at[lo : hi + 1]), pa.int64()), pa.array([to_wav(data[at[k] : at[k + 1]].tobytes()) for k in range(lo, hi)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame, keep_media: bool = False) -> DataFrame:
    """The payload's and the file's digests of each row of a media table, with its fingerprint as two arrays."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, times array<int>, pairs array<int>" + ", media binary" * keep_media

    def read(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "times", "pairs")}
                for m in part.column("media"):
                    media = m.as_py()
                    payload = from_wav(media)
                    found = peaks(differences(np.frombuffer(payload, dtype=np.uint8)))
                    times, pairs = fingerprint(found)
                    for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(found), times, pairs), strict=True):
                        out[k].append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True)), *([part.column("media")] if keep_media else [])], names=["doc_id", "n_bytes", *out, *["media"] * keep_media])

    return media.mapInArrow(read, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """The digest columns: the stored media table is written, read back and fingerprinted; `feature` names frames, pairs and a hash of the time-coded arrays.

    The arrays themselves, beside each row's media if asked for, are what `fingerprints` returns.
    """
    f = fingerprints(written(media_columns(docs), "media"))
    coded = F.lower(F.hex(F.xxhash64("times", "pairs")))
    return f.withColumn("feature", F.concat_ws(":", F.lit("stft-pairs"), F.col("n_frames").cast("string"), F.size("pairs").cast("string"), coded)).drop("times", "pairs", "n_frames")
