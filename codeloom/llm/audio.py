"""Operator 10: audio columns and their features.

``store_audio`` keeps the bytes of each text as an uncompressed 8-bit mono recording (RIFF/WAVE), padded with zero bytes
to a positive multiple of 64.  ``audio_features`` reads the stored bytes back: polyphase resampling, overlapping
log-mel frames, and segments found by energy with hysteresis.  Frames are kept as fixed-shape Arrow tensors with the
time span of each; :func:`read_tensors` reads such a cell.  Row by row: beside the batch that came in, memory holds the
results of a group of ``_GROUP_BYTES`` of recordings, which then leaves the task, or of one longer recording, and the
spectra of ``FRAMES_AT_ONCE`` frames.

Defined results: a null or empty text is 64 zero bytes and n_bytes 0; equal texts give equal values, as each text is
computed alone; features are rounded to 1/64, as far as other machines' rounding could differ.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import by_batch, renamed, table
from codeloom.llm.wordbpe import slices

RATE = 8000
UNIT = 64
UP, DOWN, TAPS = 3, 4, 12
WINDOW, HOP, MELS = 256, 128, 32
TENSOR_FRAMES = 64
FRAMES_AT_ONCE = 4096
FLOOR = -16.0
#: Quantiles of a recording's frame energies: a segment needs a frame at the upper one and lasts while above the lower.
UPPER, LOWER = 0.75, 0.4
_GROUP_BYTES = 3_000_000

_SEGMENT = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("n_frames", pa.int64()), ("tensors", pa.binary()), ("segments", pa.list_(_SEGMENT))])


def wave_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file: one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wave_payload(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of such a file."""
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or wave != b"WAVE" or size + 8 != len(media):
        raise ValueError("not a whole RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\0" * (-len(text) % unit if text else unit)


@functools.cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Taps of each phase of the resampler, the window, and the mel bank."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS) * UP / max(UP, DOWN)
    phases = np.stack([h[p::UP][::-1] for p in range(UP)])
    phases /= phases.sum(axis=1, keepdims=True)
    rate = RATE * UP / DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    hz = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return phases.astype("f4"), np.hanning(WINDOW).astype("f4"), np.clip(np.minimum(rise, fall), 0, None).astype("f4")


def resampled(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Values start to stop (start a multiple of UP) of the recording at UP / DOWN times its rate; silence around it."""
    phases = _filters()[0]
    first = start // UP * DOWN - TAPS // 2
    count = -(-(stop - start) // UP)
    need = (count - 1) * DOWN + (UP - 1) * DOWN // UP + TAPS
    x = np.zeros(need, "f4")
    a, b = max(first, 0), min(first + need, len(samples))
    if b > a:
        x[a - first : b - first] = (samples[a:b].astype("f4") - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty((count, UP), "f4")
    for r in range(UP):
        out[:, r] = windows[r * DOWN // UP :: DOWN][:count] @ phases[r * DOWN % UP]
    return out.reshape(-1)[: stop - start]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames by MELS log energies, and each frame's log energy."""
    _, window, bank = _filters()
    total = len(samples) * UP // DOWN
    frames = max(1, -(-(total - WINDOW) // HOP) + 1)
    mel, energy = [], []
    for a in range(0, frames, FRAMES_AT_ONCE):
        m = min(FRAMES_AT_ONCE, frames - a)
        begin = a * HOP // UP * UP
        y = resampled(samples, begin, a * HOP + (m - 1) * HOP + WINDOW)[a * HOP - begin :]
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, axis=1)).astype("f4") ** 2
        mel.append(np.log(np.maximum(power @ bank, np.float32(1e-7))))
        energy.append(np.log(np.maximum(power.sum(axis=1), np.float32(1e-7))))
    return np.rint(np.concatenate(mel) * 64) / 64, np.rint(np.concatenate(energy) * 64) / 64


def energy_segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges (end exclusive): runs at or above the lower threshold that reach the upper one."""
    upper, lower = np.quantile(energy, UPPER, method="lower"), np.quantile(energy, LOWER, method="lower")
    on = np.concatenate([[False], energy >= lower, [False]])
    starts, ends = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    reach = np.concatenate([[0], np.cumsum(energy >= upper)])
    hot = reach[ends] > reach[starts]
    return list(zip(starts[hot].tolist(), ends[hot].tolist(), strict=True))


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
_CELL = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", _TENSOR)])


def tensor_cell(mel: np.ndarray) -> bytes:
    """An Arrow stream: for each run of TENSOR_FRAMES frames its time span and tensor (the last filled with FLOOR)."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR, "f4")
    full[: len(mel)] = mel
    store = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * MELS)
    spans = [[seconds(k * TENSOR_FRAMES) for k in range(n)], [seconds(min((k + 1) * TENSOR_FRAMES, len(mel))) for k in range(n)]]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CELL) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(spans[0], pa.float64()), pa.array(spans[1], pa.float64()), pa.ExtensionArray.from_storage(_TENSOR, store)], schema=_CELL))
    return sink.getvalue().to_pybytes()


def read_tensors(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(cell).read_all()


def store_audio(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (without padding), media (the recording's file)."""

    def work(batch):
        for a, b in slices(batch.column(1), _GROUP_BYTES):
            part = batch.slice(a, b - a)
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wave_bytes(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return by_batch(renamed(df, id_col, text_col), work, "doc_id long, n_bytes long, media binary")


def audio_features(stored: DataFrame) -> DataFrame:
    """From ``store_audio``: also payload (read back), n_frames, tensors (an Arrow stream) and segments in seconds."""

    def work(batch):
        for a, b in slices(batch.column(2), _GROUP_BYTES):
            part, rows = batch.slice(a, b - a), []
            for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in part.columns), strict=True):
                _, payload = wave_payload(media)
                mel, energy = log_mel(np.frombuffer(payload, np.uint8))
                found = [{"start_s": seconds(s), "end_s": seconds(e)} for s, e in energy_segments(energy)]
                rows.append((doc_id, n_bytes, media, payload, len(mel), tensor_cell(mel), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FEATURES, strict=True)], schema=_FEATURES)

    return by_batch(stored.select("doc_id", "n_bytes", "media"), work, "doc_id long, n_bytes long, media binary, payload binary, n_frames long, tensors binary, segments array<struct<start_s:double,end_s:double>>")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = audio_features(store_audio(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("spans="), F.sha2(F.to_json("segments"), 256)), F.concat(F.lit("log_mel="), F.sha2("tensors", 256))).alias("feature"),
    )


QUERIES = {"op10_audio": op10_audio}
ORACLE_SQL: dict[str, str] = {}
