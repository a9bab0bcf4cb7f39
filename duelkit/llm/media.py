"""Media columns: texts stored as 8-bit WAV, read by ``wave``, and fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts

RATE = 8000
BLOCK = 64
FRAME, HOP = 256, 128
#: Frequency bins of the bands; each band of a frame offers its strongest bin.
BANDS = ((2, 12), (12, 40), (40, 128))
FAN, REACH = 2, 63

MADE = ["payload_bytes", "payload_sha256", "tail_crc32", "landmarks"]
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, landmarks array<bigint>"


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def encode_wav(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media``: the text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, as a mono 8-bit WAV file;
    and ``n_bytes``, the bytes before padding. Null text counts as empty. Columns of these names are replaced."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    size = F.greatest(F.lit(BLOCK), F.ceil(n / BLOCK) * BLOCK).cast("int")
    header = [
        F.lit(b"RIFF"), _little(size + 36, 4), F.lit(b"WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2),
        _little(F.lit(RATE), 4), _little(F.lit(RATE), 4), _little(F.lit(1), 2), _little(F.lit(8), 2), F.lit(b"data"), _little(size, 4),
    ]
    return df.withColumns({"n_bytes": n, media: F.concat(*header, F.rpad(raw, size, F.lit(b"\0")))})


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Power of the short-time Fourier transform, frames by bins; the last frame is padded with silence, so that every sample
    lies in a frame."""
    x = (samples.astype(np.float32) - 128) / 128
    x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    return np.concatenate([np.abs(np.fft.rfft((part := frames[i : i + 4096]) * window, axis=1)[:, :128]) ** 2 for i in range(0, len(frames), 4096)])


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Pairs of spectral peaks, ordered by time: ``frame << 32 | bin << 16 | later bin << 8 | frames between``.

    A peak is a band's strongest bin where that band is stronger than in the frames beside it (ties: the earlier)."""
    power = spectrogram(samples)
    found = []
    for low, high in BANDS:
        part = power[:, low:high]
        at = part.argmax(axis=1)
        top = np.round(np.log1p(part[np.arange(len(at)), at]), 4)
        before, after = np.concatenate([[-1], top[:-1]]), np.concatenate([top[1:], [-1]])
        t = np.flatnonzero((top > before) & (top >= after) & (top > 0.001))
        found.append(np.stack([t, at[t] + low]))
    t, f = np.concatenate(found, axis=1)
    order = np.lexsort((f, t))
    t, f = t[order].astype(np.int64), f[order].astype(np.int64)
    codes = []
    for ahead in range(1, FAN + 1):
        gap = t[ahead:] - t[:-ahead] if ahead < len(t) else np.zeros(0, np.int64)
        near = gap <= REACH
        codes.append((t[: len(gap)] << 32 | f[: len(gap)] << 16 | f[ahead : ahead + len(gap)] << 8 | gap)[near])
    return np.sort(np.concatenate(codes))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "media"):
        rows: list[list] = [[], [], [], []]
        for media in batch["media"]:
            if not media.is_valid:
                for column in rows:
                    column.append(None)
                continue
            with wave.open(io.BytesIO(media.as_buffer().to_pybytes())) as sound:
                payload = sound.readframes(sound.getnframes())
            for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), landmarks(np.frombuffer(payload, np.uint8))), strict=True):
                column.append(value)
        made = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch["row"], *made], names=["row", *MADE])


def read_wav(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces ``media`` by what is read from it: ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 64
    bytes) and ``landmarks`` (see :func:`landmarks`). A null file gives nulls; other columns stay, one row per row;
    input columns of these four names are replaced."""
    rest = [c for c in df.columns if c not in (media, *MADE)]
    # other columns stand in one struct, apart from those made here
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    packed = df.select(row.alias("row"), F.col(f"`{media}`").alias("media"))
    read = packed.mapInArrow(_read, StructType([packed.schema["row"], *StructType.fromDDL(READ).fields]))
    return read.select(*[F.col("row").getField(c).alias(c) for c in rest], *MADE)


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document: the text through :func:`encode_wav` and :func:`read_wav`; ``feature`` digests the landmarks, which
    follow as they are. Repeated rows and rows without an id are rows of their own."""
    stored = encode_wav(docs.select("doc_id", "text")).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    n = F.size("landmarks")
    return read_wav(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", n, F.lower(F.lpad(F.hex(F.xxhash64("landmarks")), 16, "0"))).alias("feature"), n.alias("n_landmarks"), "landmarks",
    )
