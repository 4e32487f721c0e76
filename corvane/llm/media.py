"""Audio features of 8-bit media: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

Media are RIFF/WAVE files of unsigned 8-bit mono PCM. Each is read back from its stored bytes, resampled by `up`/`down` with a
windowed-sinc polyphase filter (one phase for each of the `up` outputs between two inputs), framed with overlap, the last frame padded
with silence so that every sample is in one, and turned into tensors of a fixed shape (frames, mels). They are stored as an Arrow table
(IPC) of the fixed-shape tensor type, each with its time span; the last one is padded with the floor value. Energy segments open
above a high threshold and close below a low one.

Defined edges: a null text is empty, and its payload is 64 zero bytes. Equal media give equal features: each file is computed
by itself, in blocks of a fixed size, so memory is bounded by one file plus one block. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

RATE, BLOCK = 16000, 1 << 18
UP, DOWN = 3, 4
FRAME, HOP, MELS, FRAMES = 256, 128, 16, 32
HIGH_DB, LOW_DB = 3.0, 1.0

FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("media", pa.binary()), ("n_bytes", pa.int64()), ("n_frames", pa.int64()),
    ("tensors", pa.binary()), ("segment_start_s", pa.list_(pa.float64())), ("segment_end_s", pa.list_(pa.float64())),
])
FEATURES_DDL = (
    "doc_id long, media binary, n_bytes long, n_frames long, tensors binary, segment_start_s array<double>, segment_end_s array<double>"
)


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (64 if not raw else -len(raw) % 64)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file whose samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_wave(media: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the rate of an 8-bit mono WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def polyphase(up: int, down: int, half: int = 8) -> np.ndarray:
    """Phases of a Hann-windowed sinc low-pass: row p holds the taps for output phase p."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    taps = -(-n // up)
    return np.pad(h, (0, taps * up - n)).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down times its rate; output m takes phase (m*down)%up over the inputs that end at (m*down)//up."""
    phases = polyphase(up, down)
    taps = phases.shape[1]
    lead = taps // 2
    n_out = -(-len(x) * up // down)
    padded_x = np.concatenate([np.zeros(taps - 1 - lead, np.float32), x, np.zeros(taps + lead, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded_x, taps)
    out = np.empty(n_out, np.float32)
    for first in range(0, n_out, BLOCK):
        m = np.arange(first, min(first + BLOCK, n_out))
        at, phase = (m * down) // up, (m * down) % up
        for p in np.unique(phase):
            own = phase == p
            out[m[own]] = windows[at[own]] @ phases[p][::-1]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters on the mel scale, shape (frame // 2 + 1, mels)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edge = 700 * (10 ** (mel / 2595) - 1) / rate * frame
    k = np.arange(frame // 2 + 1)[:, None]
    rise, fall = (k - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - k) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and each frame's energy in dB; silence fills the last frame."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, filters = np.hanning(FRAME).astype(np.float32), mel_filters(rate)
    mel, db = [], []
    for first in range(0, len(frames), 1024):
        part = frames[first : first + 1024] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mel.append(np.log(power @ filters + 1e-6))
        db.append(10 * np.log10((part**2).mean(axis=1) + 1e-9))
    return np.concatenate(mel), np.concatenate(db)


def hysteresis(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Runs of frames that stay above median+low and reach median+high somewhere."""
    base = float(np.median(db))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (db > base + low).astype(np.int8), [0]])))
    peak = np.concatenate([[0], np.cumsum(db > base + high)])
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if peak[b] > peak[a]]


def tensor_blocks(mel: np.ndarray) -> np.ndarray:
    """(n, FRAMES, MELS): frames in blocks of one fixed shape."""
    n = -(-len(mel) // FRAMES)
    return np.pad(mel, ((0, n * FRAMES - len(mel)), (0, 0)), constant_values=np.float32(np.log(1e-6))).reshape(n, FRAMES, MELS)


TENSORS = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensors_to_bytes(tensors: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with their time spans."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column, pa.array(starts), pa.array(ends)], schema=TENSORS))
    return sink.getvalue().to_pybytes()


def tensors_from_bytes(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, FRAMES, MELS) values, starts and ends of a stored stream."""
    table = pa.ipc.open_stream(stored).read_all()
    return table.column("tensor").combine_chunks().to_numpy_ndarray(), table.column("start_s").to_numpy(), table.column("end_s").to_numpy()


def media_features(media: bytes) -> dict:
    """Features of one stored file, from its bytes alone."""
    samples, rate = from_wave(media)
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y, out_rate = resample(x), rate * UP / DOWN
    mel, db = log_mel(y, out_rate)
    tensors = tensor_blocks(np.round(mel, 3))
    starts = np.arange(len(tensors)) * FRAMES * HOP / out_rate
    ends = np.minimum((starts * out_rate + (FRAMES - 1) * HOP + FRAME) / out_rate, max(len(y), FRAME) / out_rate)
    spans = [(a * HOP / out_rate, ((b - 1) * HOP + FRAME) / out_rate) for a, b in hysteresis(db)]
    return {"samples": samples, "n_frames": len(mel), "tensors": tensors, "starts": starts, "ends": ends, "spans": spans}


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded, as a WAVE file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            yield batch_of(schema, doc_id=batch.column("doc_id"), n_bytes=[len(r) for r in raw], media=[to_wave(padded(r)) for r in raw])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """Features of each stored file (doc_id, n_bytes, media): tensors with time spans, and energy segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = part.column("media").to_pylist()
                f = [media_features(m) for m in own]
                yield batch_of(
                    FEATURES, doc_id=part.column("doc_id"), media=own, n_bytes=part.column("n_bytes"), n_frames=[x["n_frames"] for x in f],
                    tensors=[tensors_to_bytes(x["tensors"], x["starts"], x["ends"]) for x in f],
                    segment_start_s=[[a for a, _ in x["spans"]] for x in f], segment_end_s=[[b for _, b in x["spans"]] for x in f],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES_DDL)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row of digests for each document, from the stored bytes read back and the tensors that the operator returns."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_segments", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, n, media, frames, stored, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "n_frames", "tensors", "segment_start_s", "segment_end_s"))):
                payload = from_wave(media)[0]
                tensor = tensors_from_bytes(stored)[0].astype("<f4").reshape(-1, MELS)[:frames]
                spans = np.round(np.array([starts, ends], dtype="<f8"), 6)
                feature = f"{frames}x{MELS}:{len(starts)}:{zlib.crc32(tensor.tobytes()):08x}:{zlib.crc32(spans.tobytes()):08x}:{tensor.mean():.2f}"
                for name, value in zip(out, (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, len(starts))):
                    out[name].append(value)
            yield batch_of(schema, **out)

    return audio_features(store_texts(docs)).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"
    )
