"""Media columns: texts as WAV samples, their short-time spectra, and spectral-peak pair fingerprints.

A payload is stored losslessly as 8-bit mono samples in a WAV container and read back with the wave module.
Features come from the samples read back: a Hann-windowed Fourier transform every HOP samples, the strongest
local peak of each of BANDS frequency bands, and pairs of peaks at most REACH frames apart. A pair is one number,
(first bin, second bin, frames between); the fingerprint is the array of (frame, pair), ordered.

Payload of a text: its UTF-8 bytes, null as empty, padded with bytes 0 to a positive multiple of BLOCK. All of it
is stored and analysed, SLICE frames at a time, so a very long text needs memory for its own bytes only.
A null doc_id stays null; equal rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8000
FRAME = 256
HOP = 128
BANDS = 4
REACH = 3
SLICE = 8192
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def spectra(samples: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, magnitudes) for SLICE frames at a time; what is shorter than a frame is padded."""
    x = np.frombuffer(samples, dtype=np.uint8)
    if len(x) < FRAME:
        x = np.concatenate([x, np.full(FRAME - len(x), 128, np.uint8)])
    count = 1 + -(-(len(x) - FRAME) // HOP)
    for at in range(0, count, SLICE):
        part = x[at * HOP : (min(count, at + SLICE) - 1) * HOP + FRAME].astype(np.float32) - 128
        need = (min(count, at + SLICE) - 1 - at) * HOP + FRAME
        part = np.concatenate([part, np.zeros(need - len(part), np.float32)]) if len(part) < need else part
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield at, np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: bytes) -> np.ndarray:
    """Frames x BANDS: the bin of each band's strongest local maximum, -1 where there is none."""
    out = []
    for _, s in spectra(samples):
        inner = s[:, 1:-1]
        top = np.where((inner > s[:, :-2]) & (inner >= s[:, 2:]) & (inner > 1e-3), inner, 0)
        width = top.shape[1] // BANDS
        bands = top[:, : width * BANDS].reshape(len(top), BANDS, width)
        best = bands.argmax(axis=2)
        found = np.take_along_axis(bands, best[:, :, None], 2)[:, :, 0] > 0
        out.append(np.where(found, best + 1 + np.arange(BANDS) * width, -1))
    return np.concatenate(out).astype(np.int16)


def fingerprint(samples: bytes) -> np.ndarray:
    """Rows (frame, pair), ordered by frame: each peak with the peaks of the same band in the next REACH frames
    and with the next band's peak in its own."""
    p = peaks(samples).astype(np.int64)
    rows = []
    for gap in range(REACH + 1):
        a, b = (p[:, :-1], p[:, 1:]) if gap == 0 else (p[: max(0, len(p) - gap)], p[gap:])
        frame, band = np.nonzero((a >= 0) & (b >= 0))
        rows.append(np.stack([frame, (a[frame, band] << 12) | (b[frame, band] << 4) | gap], axis=1))
    out = np.concatenate(rows)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_pairs long, feature string, pairs array<struct<frame: int, pair: int>>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ") if not x.startswith("pair")]


def features(docs: DataFrame, *, media: bool = False) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA, with the WAV itself where asked for.

    pairs: the fingerprint, a time-coded array. feature: SHA-256 over the little-endian 32-bit numbers of all of it.
    """
    extra = ", media binary" * media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            wavs, arrays = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                stored = to_wav(payload(text))
                back = from_wav(stored)
                found = fingerprint(back).astype("<i4")
                rows.append((d, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), 1 + max(0, -(-(len(back) - FRAME) // HOP)), len(found), hashlib.sha256(found.tobytes()).hexdigest()))
                arrays.append(found)
                if media:
                    wavs.append(stored)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)]
            flat = np.concatenate(arrays) if arrays else np.zeros((0, 2), np.int32)
            coded = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], names=["frame", "pair"])
            columns.append(pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32), coded))
            if media:
                columns.append(pa.array(wavs, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=NAMES + ["pairs"] + ["media"] * media)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA + extra)
