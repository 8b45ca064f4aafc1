"""Audio columns: WAV samples, polyphase resampling, log-mel frames, energy segments, fixed-shape tensors.

A media value is a RIFF/WAVE file with one channel of 8-bit samples. `store` makes one of any bytes, `load`
reads the samples back. Features of the samples, in blocks of bounded size with the context that filters need:

1. resampling by UP / DOWN: a windowed-sinc filter in polyphase form, as products of blocks of DOWN samples with
   one small matrix for the block itself and one for each neighbour;
2. power spectra of overlapping Hann windows, summed by triangular mel filters, in decibels;
3. hysteresis over a frame's energy: a segment starts above HIGH dB and goes on until below LOW dB, both from the peak;
4. tensors of the fixed shape (SPAN frames, MELS), the last one filled up with FLOOR, each with its time span.

Null texts count as empty, which makes one padded payload. Texts of any length are stored whole and worked on in blocks. Equal texts
and repeated rows have equal values. Of frames of equal energy each is judged alone. A null media value has null features. An empty
table gives no rows. Only doc_id and text are read of documents, whatever other columns are called; of a clash in
audio_features(), the table's own frames, segments and tensors are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verivane.llm.common import small, table

RATE, UP, DOWN = 8000, 5, 8  #: samples a second, as stored; resampled to RATE * UP / DOWN
TAPS = 8  #: input samples on either side that the filter sees
FRAME, HOP, MELS = 256, 128, 20
HIGH, LOW = -6.0, -12.0
SPAN, FLOOR = 32, -100.0
PAD = 192
BLOCK = PAD * 4096  #: samples worked on at a time


# ---- the stored form -----------------------------------------------------------------------------


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file with the payload as 8-bit samples."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def load(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, from the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


# ---- features --------------------------------------------------------------------------------------


@lru_cache(1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Resampling matrices (3, DOWN, UP), Hann window, mel filters (bins, MELS)."""
    cutoff = min(1.0, UP / DOWN)
    m = np.zeros((3, DOWN, UP))
    for j in range(UP):
        centre = j * DOWN / UP  # where output j lies among the block's inputs
        for block in (-1, 0, 1):
            for i in range(DOWN):
                d = block * DOWN + i - centre
                if abs(d) < TAPS:
                    m[block + 1, i, j] = cutoff * np.sinc(cutoff * d) * (0.5 + 0.5 * np.cos(np.pi * d / TAPS))
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    return m.astype(np.float32), hann.astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resampled(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of the resampled signal; samples: a multiple of DOWN bytes."""
    before, own, after = _filters()[0]
    for at in range(0, len(samples), BLOCK):
        lo, hi = max(0, at - DOWN), min(len(samples), at + BLOCK + DOWN)
        x = (samples[lo:hi].astype(np.float32) - 128) / 128
        x = np.concatenate([np.zeros(DOWN - (at - lo), np.float32), x, np.zeros(DOWN - (hi - min(len(samples), at + BLOCK)), np.float32)]).reshape(-1, DOWN)
        yield (x[:-2] @ before + x[1:-1] @ own + x[2:] @ after).reshape(-1)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, MELS) in decibels; the last frame is filled up with silence."""
    _, hann, mels = _filters()
    out, rest, seen = [], np.empty(0, np.float32), 0
    total = -(-len(samples) // DOWN) * UP
    frames = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    for block in resampled(samples):
        seen += len(block)
        silence = np.zeros((frames - 1) * HOP + FRAME - total if seen == total else 0, np.float32)
        rest = np.concatenate([rest, block, silence])
        n = max(0, (len(rest) - FRAME) // HOP + 1)
        if n:
            out.append(_mel_of(rest, n, hann, mels))
            rest = rest[n * HOP :]
    return np.concatenate(out)


def _mel_of(x: np.ndarray, n: int, hann: np.ndarray, mels: np.ndarray) -> np.ndarray:
    windows = np.ndarray((n, FRAME), np.float32, x, 0, (HOP * x.itemsize, x.itemsize))
    spectrum = np.fft.rfft(windows * hann, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2) @ mels
    return np.maximum(10 * np.log10(power / FRAME + 1e-10), FLOOR).astype(np.float32)


def segments(mel: np.ndarray) -> np.ndarray:
    """(n, 2): first and end frame of each segment of high energy."""
    energy = 10 * np.log10(np.exp(mel * np.float32(np.log(10) / 10)).sum(1))
    energy -= energy.max()
    mark = np.where(energy >= HIGH, 1, np.where(energy < LOW, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[np.maximum(last, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active, [0]])))
    return edge.reshape(-1, 2)


def tensors(mel: np.ndarray) -> np.ndarray:
    """(spans, SPAN, MELS)."""
    n = -(-len(mel) // SPAN)
    full = np.full((n * SPAN, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    return full.reshape(n, SPAN, MELS)


def spans(n: int, frames: int) -> np.ndarray:
    """(n, 2): seconds from and to of each tensor."""
    step = HOP * DOWN / (RATE * UP)
    first = np.arange(n) * SPAN
    return np.c_[first * step, np.minimum(first + SPAN, frames) * step]


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [SPAN, MELS])


def as_arrow(mel: np.ndarray) -> bytes:
    """An Arrow stream of start_s, end_s and tensor, a row for each span."""
    t = tensors(mel)
    at = spans(len(t), len(mel))
    column = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(t.reshape(-1)), SPAN * MELS))
    batch = pa.record_batch([pa.array(at[:, 0]), pa.array(at[:, 1]), column], names=["start_s", "end_s", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


# ---- operators -------------------------------------------------------------------------------------


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 filled up with spaces to a positive multiple of PAD; and the bytes before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(PAD, -(-len(data) // PAD) * PAD) - len(data)), len(data)


def pieces(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """Slices of the batches, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def audio_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Of a table with WAVE files: its other columns, frames, segments (array of start and end seconds), tensors (Arrow stream)."""
    keep = [c for c in media.columns if c not in (column, "frames", "segments", "tensors")]
    schema = "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in keep)
    step = HOP * DOWN / (RATE * UP)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            mels = [None if m is None else log_mel(_whole(load(m)[0])) for m in b[column]]
            yield b[keep].assign(
                frames=pd.array([None if m is None else len(m) for m in mels], "Int64"),
                segments=[None if m is None else (segments(m) * step).tolist() for m in mels],
                tensors=[None if m is None else as_arrow(m) for m in mels],
            )

    return media.select(*keep, column).mapInPandas(run, schema + "frames long, segments array<array<double>>, tensors binary")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and its text as a WAVE file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "media": [store(text_payload(t)[0]) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, media binary")


def _whole(samples: bytes) -> np.ndarray:
    """Filled up with silence to whole blocks of DOWN."""
    x = np.frombuffer(samples, np.uint8)
    return x if len(x) and len(x) % DOWN == 0 else np.r_[x, np.full(max(DOWN, -(-len(x) // DOWN) * DOWN) - len(x), 128, np.uint8)]


def digest(stored: bytes) -> str:
    """Of stored tensors, as read back: frames, tensors and their shape, a checksum of their time spans; segments, active frames, a
    checksum of the segments; the mean of each mel band."""
    t = from_arrow(stored)
    x = t["tensor"].combine_chunks().to_numpy_ndarray()
    at = np.c_[t["start_s"].to_numpy(), t["end_s"].to_numpy()]
    mel = x.reshape(-1, MELS)[: round(at[-1, 1] * RATE * UP / (HOP * DOWN))]
    s = segments(mel)
    crc = lambda v, kind: zlib.crc32(v.astype(kind).tobytes())
    head = f"frames={len(mel)};tensors={len(x)};shape={x.shape[1]}x{x.shape[2]};spans={crc(at, '<f8')};segments={len(s)};active={int((s[:, 1] - s[:, 0]).sum())};edges={crc(s, '<u4')}"
    return f"{head};mel=" + ",".join(map(str, np.round(mel.mean(0, dtype=np.float64), 1).tolist()))


def describe(docs: DataFrame) -> DataFrame:
    """Stores each text, reads it back, stores its features as tensors and describes what is read from these."""

    def row(doc_id, text) -> tuple:
        payload, n = text_payload(text)
        media = store(payload)
        back = load(media)[0]
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), digest(as_arrow(log_mel(_whole(back))))

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [row(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


def op8_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "documents"))


QUERIES = {"op8_media_audio": op8_media_audio}
ORACLE_SQL: dict[str, str] = {}  # signal processing: tests compare with direct sums and an exact round trip
