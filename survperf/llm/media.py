"""Media columns: texts' bytes as WAV samples, their spectra and spectral-peak fingerprints.

``to_wav`` stores a payload losslessly as 8-bit mono samples; ``read_wav`` reads it back with
the wave module; ``landmarks`` are pairs of spectral peaks of a short-time Fourier transform, each
packed with its time into one integer. Frames overlap by half and the samples are padded by half a frame at
either end, so that every byte lies near the middle of some frame. A frame's peaks are the bins that are
stronger than both their neighbours and ``ABOVE`` times the frame's mean, the ``PEAKS`` strongest of them; each
peak is paired with the ``FAN_OUT`` peaks that follow it, in its frame by bin and then in later frames, as far as
``REACH`` frames.

Defined cases: a null payload is empty; an empty payload is padded to 64 zero bytes; equal
payloads give equal columns. ``with_media`` replaces input columns of the names it adds.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import small_batches

BLOCK = 64
RATE = 8000
FRAME = 256
HOP = 128
#: Peaks of a frame, how far above its mean, the partners of a peak, and the frames between them.
PEAKS, ABOVE, FAN_OUT, REACH = 3, 1.5, 3, 3
#: Frames transformed at once.
CHUNK = 4096


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with bytes 0 up to a positive multiple of ``BLOCK``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of all spectral peaks, in that order."""
    x = np.frombuffer(samples, np.uint8)
    count = -(-len(x) // HOP) + 1
    padded = np.full((count - 1) * HOP + FRAME, 128, np.uint8)
    padded[FRAME // 2 : FRAME // 2 + len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    for at in range(0, count, CHUNK):
        # whole numbers, so that equal payloads have equal peaks on every machine
        power = np.rint(np.abs(np.fft.rfft((frames[at : at + CHUNK].astype(np.float32) - 128) * window, axis=1))[:, 1:]).astype(np.int32)
        high = power * power.shape[1] > ABOVE * power.sum(1, keepdims=True, dtype=np.int64)
        high[:, 1:] &= power[:, 1:] > power[:, :-1]
        high[:, :-1] &= power[:, :-1] >= power[:, 1:]
        # the strongest, of equal ones the lowest bins
        rank = np.where(high, power.astype(np.int64) * FRAME + np.arange(power.shape[1], 0, -1), 0)
        least = np.partition(rank, -PEAKS, axis=1)[:, -PEAKS, None]
        frame, bin_ = np.nonzero(high & (rank >= least))
        found.append((frame + at, bin_ + 1))
    return np.concatenate([f for f, _ in found]).astype(np.int64), np.concatenate([b for _, b in found]).astype(np.int64)


def landmarks(samples: bytes) -> list[int]:
    """(frame << 20 | first bin << 12 | second bin << 4 | frames between) of peak pairs, ascending."""
    frame, bin_ = peaks(samples)
    marks = []
    for step in range(1, FAN_OUT + 1):
        apart = frame[step:] - frame[:-step]
        near = apart <= REACH
        marks.append(((frame[:-step] << 20) | (bin_[:-step] << 12) | (bin_[step:] << 4) | apart)[near])
    return np.sort(np.concatenate(marks)).tolist()


MEDIA = "media binary, payload binary, n_bytes long, landmarks array<long>"


def with_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with media (the WAV), payload (read back from it), n_bytes (unpadded) and landmarks."""
    small_batches(df.sparkSession)

    @F.pandas_udf(MEDIA)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                media = to_wav(payload_of(t))
                back = read_wav(media)
                rows.append((media, back, len((t or "").encode("utf-8", "surrogatepass")), landmarks(back)))
            yield pd.DataFrame(rows, columns=["media", "payload", "n_bytes", "landmarks"])

    names = ["media", "payload", "n_bytes", "landmarks"]
    # the input's columns stay inside a struct, so that none has a name of ours
    made = df.select(F.struct("*").alias("row"), make(F.col(text_col)).alias("made"))
    return made.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *[f"made.{n}" for n in names])


def fingerprint_of(marks: np.ndarray | list[int]) -> str:
    """Short text form of landmarks: their number and a digest."""
    return f"{len(marks)}:{hashlib.sha1(np.asarray(marks, '<i8').tobytes()).hexdigest()}"
