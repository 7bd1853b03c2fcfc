"""Audio columns: lossless 8-bit PCM, polyphase resampling, log-mel filterbanks and energy segments.

Features of a clip are kept as an Arrow stream with one row for each segment: its time span and a
fixed-shape tensor of log-mel frames.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from braidlake.llm.common import fresh, schema_of, table
from braidlake.llm.words import blocks

RATE = 8000
UP, DOWN = 1, 2
FRAME, HOP, MELS = 256, 128, 20
#: Frames of a segment's tensor: the segment's frames are averaged into so many equal spans.
SPANS = 8
#: An energy above HIGH times the median opens a segment, one below LOW times it closes it.
HIGH, LOW = 1.05, 0.95
#: Frames computed at a time, so that memory doesn't follow the clip's length.
BLOCK = 1024


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples: the payload's bytes as they are."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) read back from the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            layout, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (layout, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def _filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """Phases of a windowed-sinc low pass: row p has the taps for outputs at p/up between two inputs."""
    cut = 1 / max(up, down)
    n = np.arange(-half * max(up, down), half * max(up, down) + 1)
    taps = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    return taps.reshape(-1, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output is one phase's taps over the inputs around it; no zeros are ever multiplied.

    Outputs lie at multiples of down/up input samples; beyond its ends the signal counts as 0.
    """
    phases = _filter(up, down)
    width, half = phases.shape[1], 8 * max(up, down)
    n = -(-len(x) * up // down)
    lead = width - 1
    padded = np.concatenate([np.zeros(lead, np.float32), x.astype(np.float32), np.zeros(width + half, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for start in range(0, n, BLOCK * 64):
        k = np.arange(start, min(n, start + BLOCK * 64)) * down + half
        q, p = k // up, k % up
        for phase in range(up):
            on = p == phase
            if on.any():
                at = q[on]
                rows = windows[at[0] : at[-1] + 1 : max(1, at[1] - at[0] if len(at) > 1 else 1)]
                out[start : start + len(k)][on] = rows @ phases[phase][::-1]
    return out


@lru_cache(8)
def _mel(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles on the mel scale, (bins, mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS): overlapped Hann frames, at least one; the last one is filled up with zeros."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)]) if (frames - 1) * HOP + FRAME > len(x) else x
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    window, bank = np.hanning(FRAME).astype(np.float32), _mel(rate, FRAME, MELS)
    out = np.empty((frames, MELS), np.float32)
    for s in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(view[s : s + BLOCK] * window, axis=1)
        out[s : s + BLOCK] = np.log(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank, 1e-10))
    return out


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """[from, to) frames: opened by an energy of `high` at least, closed by one below `low`; hysteresis between them."""
    state = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], np.where(known >= 0, state[known] == 1, False), [False]])
    edge = np.flatnonzero(np.diff(on.astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((n, SPANS, MELS) tensors, (n, 2) seconds) of a clip's segments; the whole clip where none stands out."""
    payload, rate = from_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x)
    rate = rate * UP // DOWN
    mel = log_mel(x, rate)
    energy = np.exp(mel).sum(1)
    middle = float(np.median(energy))
    spans = np.array(segments(energy, HIGH * middle, LOW * middle) or [(0, len(mel))])
    # Each segment's frames into SPANS parts of equal length, a frame at least: means by prefix sums.
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    cut = spans[:, :1] + np.arange(SPANS + 1) * (spans[:, 1:] - spans[:, :1]) / SPANS
    a = np.floor(cut[:, :-1]).astype(int)
    b = np.maximum(a + 1, np.ceil(cut[:, 1:]).astype(int))
    tensors = ((total[b] - total[a]) / (b - a)[..., None]).astype(np.float32)
    seconds = spans * HOP / rate
    seconds[:, 1] += (FRAME - HOP) / rate
    return tensors, seconds.astype(np.float32)


def to_arrow(tensors: np.ndarray, seconds: np.ndarray) -> bytes:
    """An Arrow stream: start and end in seconds, and log-mel as a fixed-shape tensor."""
    kind = pa.fixed_shape_tensor(pa.float32(), tensors.shape[1:], dim_names=["span", "mel"])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), int(np.prod(tensors.shape[1:])))
    batch = pa.RecordBatch.from_arrays([pa.array(seconds[:, 0]), pa.array(seconds[:, 1]), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "log_mel"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_arrow(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t["log_mel"].combine_chunks().to_numpy_ndarray(), np.stack([t["start_s"].to_numpy(), t["end_s"].to_numpy()], 1)


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


#: New columns and their types.
_MADE = (
    ("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()),
    ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("segments", "int", pa.int32()),
    ("spans", "array<struct<start_s:float,end_s:float>>", pa.list_(pa.struct([("start_s", pa.float32()), ("end_s", pa.float32())]))),
    ("tensors", "binary", pa.binary()), ("media", "binary", pa.binary()),
)


def media_columns(docs: DataFrame, text: str, columns: list[str], keep_media: bool = False, keep_tensors: bool = False) -> DataFrame:
    """The columns with the clip of each text and its features.

    spans are the segments' times; feature is "spans x mels:" and the SHA-256 of the Arrow stream that
    holds the segments' log-mel tensors of fixed shape and their times. keep_tensors: also `tensors`, that
    stream; keep_media: both, and `media`, the clip's file.

    Null texts are empty: a clip of 64 zero bytes. All depends on the text alone, so equal texts have
    equal values, and repeated rows a row each; the longest texts are done whole, in blocks of frames; an
    empty table gives no rows. Where one of the columns has the name of a new one, the new one takes _
    before its name.
    """
    made = _MADE if keep_media else _MADE[:-1] if keep_tensors else _MADE[:-2]
    names = fresh(columns, *(n for n, *_ in made))
    schema = schema_of(docs, columns) + ", ".join(f"`{n}` {kind}" for n, (_, kind, _) in zip(names, made, strict=True))

    def one(text: str) -> tuple:
        raw = text.encode()
        media = to_wav(payload_of(raw))
        back, _ = from_wav(media)
        tensors, seconds = features(media)
        stored = to_arrow(tensors, seconds)
        spans = [{"start_s": a, "end_s": b} for a, b in seconds.tolist()]
        row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{SPANS}x{MELS}:{hashlib.sha256(stored).hexdigest()}", len(tensors), spans, stored, media)
        return row[: len(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, column in blocks(whole.column(text)):
                b = whole.slice(start, len(column))
                rows = [one(t or "") for t in column.to_pylist()]
                new = [pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], names=[*columns, *names])

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's clip, with its segments' time spans and their log-mel tensors."""
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"], keep_tensors=True)
