"""Media columns: audio features of 8-bit samples.

A payload is held as a WAV file of 8-bit mono samples and read back from its stored
bytes. Features: polyphase resampling by 3/4, log-mel filterbanks of overlapped frames,
and segments by hysteresis on the frames' energy. `features` gives fixed-shape tensors
(`WINDOW` frames x `MELS` bands, zero-padded) with their time spans, `tensor_table`
holds them as a fixed-shape tensor Arrow column. Frames are centred, so the first span begins half a frame before the first sample. A file is worked on in blocks of
frames; what is held whole follows its length by some ten bytes a byte: the payload, the
stored file, what is read back, and the features.

Edge cases: null and empty texts are one padded payload of spaces; equal texts give
equal values wherever they lie; other columns are not read, whatever their names; an
empty table gives no rows; null ids and repeated rows are carried through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import arrow_map, text_slices

RATE, UP, DOWN = 16_000, 3, 4
FRAME, HOP, FFT, MELS, WINDOW = 256, 96, 256, 32, 64
HALF = FRAME // 2
UNIT = 192
BLOCK = 2048


def payload(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of UNIT bytes."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text.ljust(size, b" ")


def store(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    pad = len(samples) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def load(stored: bytes) -> tuple[bytes, int]:
    """Samples and rate of a stored file, by its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, (size,) = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", stored, at + 12)[0]
        elif name == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _taps(up: int, down: int, lobes: int = 6) -> np.ndarray:
    """Windowed-sinc low pass, one row a phase."""
    half = lobes * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.hamming(len(n)) * up / max(up, down)
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return h.reshape(-1, up).T[:, ::-1].copy()


_PHASES = _taps(UP, DOWN)


def resample(x: np.ndarray, first: int = 0, last: int | None = None, up: int = UP, down: int = DOWN, phases: np.ndarray = _PHASES) -> np.ndarray:
    """Outputs first to last of polyphase resampling (all by default): output n takes the taps of phase n * down mod up."""
    width = phases.shape[1]
    last, delay = -(-len(x) * up // down) if last is None else last, phases.shape[1] * up // 2
    if last <= first:
        return np.zeros(0)
    # inputs from lo on, zeros where there are none
    lo, hi = (first * down + delay) // up - (width - 1), ((last - 1) * down + delay) // up + 1
    part, a, b = np.zeros(hi - lo), max(lo, 0), min(hi, len(x))
    if a < b:
        part[a - lo : b - lo] = x[a:b]
    windows, out = np.lib.stride_tricks.sliding_window_view(part, width), np.empty(last - first)
    for n in range(first, min(first + up, last)):
        out[n - first :: up] = windows[(n * down + delay) // up - (width - 1) - lo :: down][: -(-(last - n) // up)] @ phases[(n * down + delay) % up]
    return out


def _mel_bank() -> np.ndarray:
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, DOWN / UP / RATE)[:, None]
    return np.maximum(0, np.minimum((f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])))


_BANK, _HANN = _mel_bank(), np.hanning(FRAME)


def frame_count(total: int) -> int:
    """Frames of so many resampled samples."""
    return -(-total // HOP) + 1


def log_mel(samples: np.ndarray) -> np.ndarray:
    """float32 log energies of 8-bit samples after resampling, a row a frame. Frames are centred on every HOP-th sample from the first to the last or beyond, with zeros outside, so that no sample lies only where the window vanishes. Worked on BLOCK frames at a time."""
    total = -(-len(samples) * UP // DOWN)
    n = frame_count(total)
    out = np.empty((n, MELS), np.float32)
    for s in range(0, n, BLOCK):
        count = min(BLOCK, n - s)
        begin = s * HOP - HALF
        first, last = max(begin, 0), min((s + count - 1) * HOP + HALF, total)
        reach = 2 * _PHASES.shape[1]  # inputs that the taps may need around the block
        a, b = max(first * DOWN // UP // DOWN * DOWN - reach * DOWN, 0), min(last * DOWN // UP + reach * DOWN, len(samples))
        x = np.zeros((count - 1) * HOP + FRAME)
        shift = a * UP // DOWN  # a is a multiple of DOWN, so outputs keep their phase
        x[first - begin : last - begin] = resample((samples[a:b].astype(np.float64) - 128) / 128, first - shift, last - shift)
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _HANN, FFT)) ** 2
        out[s : s + count] = np.round(np.log(power @ _BANK + 1e-6), 2)  # stored to a hundredth
    return out


def segments(energy: np.ndarray, high: float = 0.25, low: float = 0.1) -> list[tuple[int, int]]:
    """[start, end) of frames: opens above the high level, closes below the low one; levels lie between the 5th and 95th percentile."""
    a, b = np.percentile(energy, [5, 95])
    state = np.where(energy > a + high * (b - a), 1, np.where(energy < a + low * (b - a), 0, -1))
    known = np.flatnonzero(state >= 0)
    if not len(known):
        return []
    last = np.searchsorted(known, np.arange(len(energy)), "right") - 1
    on = np.where(last >= 0, state[known[np.maximum(last, 0)]], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def analyse(stored: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Samples, log-mel rows and segments of a stored file."""
    samples, _ = load(stored)
    mel = log_mel(np.frombuffer(samples, np.uint8))
    return samples, mel, segments(mel.mean(1))


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for i, j, data, offs in text_slices(batch):
            raw = data.tobytes()
            yield batch, i, [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def tensors(mel: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    """The stored features of one text: a row a fixed-shape tensor, the last padded with zeros, with its time span in seconds and the frames in segments."""
    second, n = RATE * UP / DOWN, -(-len(mel) // WINDOW)
    inside = np.zeros(len(mel), bool)
    for a, b in found:
        inside[a:b] = True
    padded = np.zeros((n * WINDOW, MELS), np.float32)
    padded[: len(mel)] = mel
    ends = np.minimum(np.arange(1, n + 1) * WINDOW, len(mel))
    active = [int(inside[w * WINDOW : (w + 1) * WINDOW].sum()) for w in range(n)]
    made = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS)), pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), WINDOW * MELS))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array((np.arange(n) * WINDOW * HOP - HALF) / second), pa.array(((ends - 1) * HOP + HALF) / second), pa.array(active, pa.int32()), made], names=["window", "start_s", "end_s", "active_frames", "tensor"])


def frames_of(rows: pa.RecordBatch) -> np.ndarray:
    """The log-mel rows of a text's tensors, without the padding that their time spans leave out."""
    n = round((rows.column("end_s")[-1].as_py() * RATE * UP / DOWN - HALF) / HOP) + 1
    return rows.column("tensor").storage.flatten().to_numpy().reshape(-1, MELS)[:n]


def features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): a row a tensor (flat, row by row) with its time span in seconds and the frames in segments."""

    def make(batches):
        for batch, i, texts in _rows(batches):
            for k, text in enumerate(texts):
                _, mel, found = analyse(store(payload(text)))
                rows = tensors(mel, found)
                n = rows.num_rows
                # Spark's lists have no fixed shape: tensor_table() gives it back
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WINDOW * MELS), rows.column("tensor").storage.flatten())
                ids = batch.column(0).slice(i + k, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *rows.columns[:-1], lists], names=["doc_id", *rows.schema.names])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, window int, start_s double, end_s double, active_frames int, tensor array<float>")


def tensor_table(rows: pa.Table) -> pa.Table:
    """features' rows with the tensor column as fixed-shape tensors of WINDOW x MELS."""
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS))
    flat = rows.column("tensor").combine_chunks()
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), WINDOW * MELS)
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, storage))


def digests(docs: DataFrame) -> DataFrame:
    """A row a document: what was stored, what came back and a digest of the features, taken from their tensors."""

    def make(batches):
        for batch, i, texts in _rows(batches):
            out: list[list] = [[] for _ in range(7)]
            seen: dict[bytes, tuple] = {}
            for text in texts:
                if text not in seen:
                    stored = store(payload(text))
                    back, mel, found = analyse(stored)
                    mel = frames_of(tensors(mel, found))
                    spans = np.array(found, np.int32)
                    text_of = f"{len(mel)}x{MELS};{len(found)};{zlib.crc32(mel.tobytes()):08x};{zlib.crc32(spans.tobytes()):08x}"
                    seen[text] = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), text_of)
                for x, v in zip(out, seen[text], strict=True):
                    x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
