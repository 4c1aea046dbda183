"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload is stored as mono 8-bit samples by the ``wave`` module and read back from those bytes.
Of each frame of the transform the strongest local peaks stay; each peak is paired with the next
few peaks, of its own frame or those behind it. A pair is a code (both bins and the frames between) at the
frame of its first peak: two arrays, ordered by time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table, text_batches, text_column

UNIT = 64
RATE = 8000
WINDOW, HOP = 512, 256
PEAKS, FAN_OUT, REACH = 3, 4, 15
#: Frames transformed at once, which bounds memory for long media.
FRAME_BLOCK = 2048
_HANN = np.hanning(WINDOW).astype(np.float32)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(data) // unit) * unit)
    return data + bytes(size - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit file; raises wave.Error or ValueError on any other."""
    with wave.open(io.BytesIO(data), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("only mono 8-bit media are read")
        return f.readframes(f.getnframes()), f.getframerate()


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest local maxima of each frame's spectrum, by frame and bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    times, bins = [], []
    for at in range(0, n, FRAME_BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + FRAME_BLOCK] * _HANN, axis=1)).astype(np.float32)[:, 2:-1]
        inner = power[:, 1:-1]
        local = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.argpartition(local, -PEAKS, axis=1)[:, -PEAKS:]
        keep = np.take_along_axis(local, best, axis=1) > 0
        t, k = np.nonzero(keep)
        f = best[t, k] + 3
        order = np.lexsort((f, t))
        times.append(t[order] + at)
        bins.append(f[order])
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of the pairs of each peak with its next FAN_OUT peaks that are at most REACH
    frames away; code: first bin, second bin and frames between."""
    at, codes = [], []
    for j in range(1, FAN_OUT + 1):
        i = np.arange(max(0, len(times) - j))
        i = i[times[i + j] - times[i] <= REACH]
        o = i + j
        at.append(times[i])
        codes.append((bins[i] << 13) | (bins[o] << 4) | (times[o] - times[i]))
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_codes array<int>"


def media_features(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores each text's UTF-8 bytes as WAV, reads them back and computes peak pairs.

    Returns a row for each row: sizes and digests of the payload read back and of the stored
    form, ``feature`` (a digest of the pairs with their number), the pair arrays, and with
    ``with_media`` the stored bytes. Equal texts give equal values. Null text counts as empty:
    64 zero bytes. A null doc_id stays null, an empty table gives no rows, other columns are not
    read. A constant signal has no peaks and an empty pair list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = MEDIA_SCHEMA.replace(",", "").split()[::2] + ["media"] * with_media
        for batch in text_batches(batches):
            rows: dict[str, list] = {x: [] for x in fields}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8")
                media = to_wav(pad(raw))
                back, _ = from_wav(media)
                at, codes = peak_pairs(*peaks(back))
                digest = hashlib.blake2b(at.astype("<i4").tobytes() + codes.astype("<i4").tobytes(), digest_size=12).hexdigest()
                values = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(at)}:{digest}", at, codes, media)
                for k, x in zip(fields, values):
                    rows[k].append(x)
            kinds = {"doc_id": pa.int64(), "pair_times": pa.list_(pa.int32()), "pair_codes": pa.list_(pa.int32()), "media": pa.binary()}
            columns = [pa.array(v, kinds.get(k, pa.string() if k.endswith("256") or k == "feature" else pa.int64())) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(columns, fields)

    return docs.select(F.col("doc_id").cast("long"), text_column(docs)).mapInArrow(run, MEDIA_SCHEMA + ", media binary" * with_media)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(bound_batches(spark), sf_dir, "documents"))
