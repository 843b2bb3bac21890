"""Texts as WAV media: stored by the wave module, read back, and fingerprinted by spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proteinscan.llm.common import slices

BLOCK = 576
RATE = 8000
HOP = 576
FRAME = 1152
FAN_OUT = 2

FEATURE_TYPE = "array<struct<frame: int, low: int, high: int, gap: int>>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit WAV whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV")
        return r.readframes(r.getnframes())


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 255 up to a positive multiple of `block`."""
    return data + b"\xff" * (block - len(data) if not data else -len(data) % block)


_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Bands of the spectrum; a frame has at most one peak in each.
BANDS = ((2, 40), (40, 160), (160, FRAME // 2))
#: Frames that are transformed at once, so that a long recording needs little memory.
FRAMES = 512


def spectrum(frames: np.ndarray) -> np.ndarray:
    """Magnitudes of the windowed Fourier transform of each frame."""
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1))


def spectral_pairs(samples: bytes) -> np.ndarray:
    """Rows (frame, bin, bin of a later peak, frames between) of a short-time Fourier transform.

    The strongest bin of a band is a peak of its frame if no bin beside it is stronger and it
    exceeds the band's mean over the whole recording. A peak is paired with the peaks of the same
    band in the next `FAN_OUT` frames. A recording without a pair has one of gap 0: the strongest
    bin of its first frame with itself.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    n = len(frames)
    bins, level = np.empty((n, len(BANDS)), np.int32), np.empty((n, len(BANDS)), np.float32)
    local, total = np.empty((n, len(BANDS)), bool), np.zeros(len(BANDS))
    loudest = 0
    for at in range(0, n, FRAMES):
        power = spectrum(frames[at : at + FRAMES])
        rows, part = np.arange(len(power)), slice(at, at + len(power))
        if at == 0:
            loudest = int(power[0].argmax())
        for k, (low, high) in enumerate(BANDS):
            top = power[:, low:high].argmax(axis=1) + low
            bins[part, k], level[part, k] = top, power[rows, top]
            local[part, k] = (power[rows, top - 1] <= level[part, k]) & (power[rows, top + 1] <= level[part, k])
            total[k] += power[:, low:high].sum(dtype=np.float64)
    mean = total / (n * np.array([high - low for low, high in BANDS]))
    peak = local & (level > mean)
    out = []
    for gap in range(1, FAN_OUT + 1):
        at, band = np.nonzero(peak[:-gap] & peak[gap:])
        out.append(np.stack([at, bins[at, band], bins[at + gap, band], np.full(len(at), gap)], axis=1))
    pairs = np.concatenate(out).astype(np.int32)
    if not len(pairs):
        return np.array([[0, loudest, loudest, 0]], np.int32)
    return pairs[np.lexsort((pairs[:, 3], pairs[:, 1], pairs[:, 0]))]


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Media digests and time-coded spectral pairs of every text, `media` itself on request.

    The text's UTF-8 bytes (null: none) are padded to blocks, stored as WAV and read back; payload
    columns describe what was read. Equal texts give equal values; repeated rows give a row each,
    ids may be null; an empty table gives none; other columns are ignored. A text that is shorter
    than three blocks is one frame and has one pair of gap 0.
    """
    kinds = {
        "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "media": pa.binary(),
    }
    fields = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, pairs {FEATURE_TYPE}"

    def described(text: str | None) -> tuple[tuple, np.ndarray]:
        data = (text or "").encode()
        stored = to_wav(padded(data))
        back = from_wav(stored)
        digests = len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest()
        return (*digests, stored if keep_media else None), spectral_pairs(back)

    def store(batches):
        for batch in slices(batches, 64):
            if not batch.num_rows:
                continue
            found = [described(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").to_pylist(), *map(list, zip(*(row for row, _ in found), strict=True))]
            arrays = {n: pa.array(c, k) for c, (n, k) in zip(columns, kinds.items(), strict=True)}
            flat = np.concatenate([p for _, p in found])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], names=["frame", "low", "high", "gap"])
            arrays["pairs"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for _, p in found)]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    out = docs.select("doc_id", "text").mapInArrow(store, fields)
    return out if keep_media else out.drop("media")


def feature_text(pairs: Column) -> Column:
    """The pairs as `frame:low-high+gap` in time order, for output as text."""

    def one(pair: Column) -> Column:
        return F.concat(*(x for mark, name in zip(("", ":", "-", "+"), ("frame", "low", "high", "gap"), strict=True) for x in (F.lit(mark), pair[name].cast("string"))))

    return F.array_join(F.transform(pairs, one), " ")
