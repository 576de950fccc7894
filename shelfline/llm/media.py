"""Media columns: bytes kept as WAV sound, and fingerprints of the sound from pairs of spectral peaks."""

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

from .common import stored, text_of

#: Payloads are filled up with spaces to a positive multiple of BLOCK bytes.
BLOCK, RATE = 192, 8000
#: Frames of a short-time Fourier transform, their distance, the peaks kept of a frame, and how many following frames
#: the strongest peak is paired with.
FRAME, HOP, PEAKS, FAN = 192, 96, 4, 2
#: Frames transformed at once, which bounds memory whatever the length of the sound.
FRAMES_AT_ONCE = 4096


def wav_of(payload: bytes) -> bytes:
    """A mono WAV file with one 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono is expected")
        return f.readframes(f.getnframes())


_WINDOW = np.hamming(FRAME).astype(np.float32)


def peaks(samples: bytes) -> np.ndarray:
    """The PEAKS strongest frequency bins of each frame, strongest first (ties: the lower bin)."""
    wave_ = np.frombuffer(samples, np.uint8).astype(np.float32) / 128
    wave_ = np.diff(wave_, prepend=wave_[:1])  # the change: else the level hides what a short sound has
    n = 1 + (len(wave_) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP][:n]
    found = []
    for at in range(0, n, FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE]
        spectrum = np.abs(np.fft.rfft(part * _WINDOW, axis=1)[:, 1:]).round(3)
        best = np.empty((len(part), PEAKS), np.int64)
        every = np.arange(len(part))
        for k in range(PEAKS):
            best[:, k] = spectrum.argmax(1)
            spectrum[every, best[:, k]] = -1
        found.append(best + 1)
    return np.concatenate(found)


def pair_codes(found: np.ndarray) -> np.ndarray:
    """Time-coded pairs (frame << 32 | bin << 16 | other bin << 8 | frames between), in ascending order: a frame's
    strongest peak with its other ones, so that one frame alone has pairs, and with those of the FAN frames after it."""
    time = np.arange(len(found), dtype=np.int64)
    codes = [(time << 32) | (found[:, 0] << 16) | (found[:, b] << 8) for b in range(1, PEAKS)]
    for gap in range(1, FAN + 1):
        codes.append((time[:-gap] << 32) | (found[:-gap, 0] << 16) | (found[gap:, 0] << 8) | gap)
    return np.sort(np.concatenate(codes))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, as a
    WAV file. Null counts as empty, so every row has one block at least; repeated rows are repeated, an empty table is
    empty, extra columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).cast(pa.binary()).to_pylist()
            media = [wav_of(p.ljust(max(1, -(-len(p) // BLOCK)) * BLOCK, b" ")) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, payloads)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Reads the media column back: payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256 and codes (the sound's peak pairs, an array of long). Equal media give equal values; an empty table
    gives an empty one; extra columns are not looked at."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "codes": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(2):
                data = item.as_py()
                payload = samples_of(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), pair_codes(peaks(payload))))
            columns = {k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds.items())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | columns)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<long>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the media of docs and then their codes to the shared folder, and returns what is read back, with n_pairs
    and feature (a digest of the stored codes) in place of the codes. Rows as encode_media and read_media have them."""
    media = stored(encode_media(docs, id_col, text_col), "media", "zstd")
    read = stored(read_media(media), "fingerprints", "zstd")
    digest = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "codes")), 16, "0") for i in range(2)))
    return read.withColumn("n_pairs", F.size("codes").cast("long")).withColumn("feature", F.lower(digest)).drop("codes")
