"""Audio columns: 8-bit WAV media, and features read back from the stored bytes.

1. ``store_media`` writes every text's bytes as a WAV into a stored table.
2. ``store_features`` reads the media again, and analyzes them: polyphase resampling, overlapped log-mel
   filterbanks, hysteresis energy segmentation.  Filterbanks are stored in windows of a fixed shape, as
   Arrow fixed-shape tensors with time spans, in Parquet files of the shared folder.
3. ``read_features`` reads those files again and gives one row for each document.

Nothing is shuffled.  A signal is analyzed in pieces, so what a task holds beside the media is the
filterbank of one document.  Files get a temporary name and are renamed when complete, so a task that is run again
replaces its file.

Defined results: a null text is empty; an empty text is one block of padding; equal texts have equal
values; repeated rows give a row each, also those without an id; very long texts give many windows; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices, table

BLOCK = 576
RATE, UP, DOWN, TAPS = 8000, 3, 4, 24
FRAME, HOP, MELS = 256, 128, 20
#: Frames in a stored tensor, and in a piece of analysis.
WINDOW, PIECE = 64, 512
#: Milliseconds from a frame to the next.
STEP_MS = HOP * 1000 * DOWN / (RATE * UP)


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded by bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def encode(payload: bytes) -> bytes:
    """A mono WAV of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV")
        return w.readframes(w.getnframes())


@functools.cache
def _phases(up: int, down: int, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """A windowed-sinc low pass, split into phases: taps of each, and where each begins."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1] / max(up, down) * up
    at = np.arange(up) * down
    return np.stack([h[p % up :: up][::-1] for p in at]).astype(np.float32), at // up


def resampled_length(n: int, up: int = UP, down: int = DOWN) -> int:
    return -(-n * up // down)


def resample(x: np.ndarray, first: int = 0, last: int | None = None, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Samples [first, last) of x at up/down times its rate, phase by phase: none is made only to be thrown away.

    Output i has phase i % up and begins at input (i // up) * down + begins[phase] - taps // 2; outside of x all is zero.
    """
    h, begins = _phases(up, down, taps)
    n = resampled_length(len(x), up, down)
    last = n if last is None else min(last, n)
    low, high = first // up, -(-last // up)
    blocks = max(0, high - low)
    a, b = low * down - taps // 2, high * down + 2 * taps
    padded = np.zeros(b - a, dtype=np.float32)
    padded[max(0, -a) : max(0, min(b, len(x)) - a)] = x[max(0, a) : max(0, min(b, len(x)))]
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty((blocks, up), dtype=np.float32)
    for p in range(up):
        out[:, p] = view[begins[p] :: down][:blocks] @ h[p]
    return out.reshape(-1)[first - low * up : last - low * up]


@functools.cache
def _mel(rate: float) -> tuple[np.ndarray, np.ndarray]:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, fall)).astype(np.float32)


def frames_of(n: int) -> int:
    """Frames that n samples need."""
    return max(1, -(-(n - FRAME) // HOP) + 1)


def log_mel(x: np.ndarray, rate: float = RATE * UP / DOWN, frames: int | None = None) -> np.ndarray:
    """Log-mel energies (frames, bands) of frames that overlap by half, and their energy in dB last."""
    hann, bank = _mel(rate)
    frames = frames_of(len(x)) if frames is None else frames
    padded = np.zeros((frames - 1) * HOP + FRAME, dtype=np.float32)
    padded[: len(x)] = x[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(view * hann, axis=1)) ** 2
    out = np.empty((frames, MELS + 1), dtype=np.float32)
    out[:, :MELS] = np.log10(power.astype(np.float32) @ bank + 1e-3)
    out[:, MELS] = 10 * np.log10(power.sum(1) + 1e-3)
    return out


def segments(energy: np.ndarray, high: float = 3.0, low: float = 0.0) -> np.ndarray:
    """(first, last + 1) frames of spans that begin above median + high and go on to median + low."""
    middle = np.median(energy)
    says = np.where(energy > middle + high, 1, np.where(energy < middle + low, 0, -1))
    known = np.maximum.accumulate(np.where(says >= 0, np.arange(len(says)), -1))
    on = np.concatenate([[0], np.where(known >= 0, says[known], 0), [0]])
    return np.stack([np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)], axis=1)


def analyze(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and the spans of a payload, made in pieces of 512 frames."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    n = resampled_length(len(samples))
    frames = frames_of(n)
    reach = (2 * TAPS + PIECE * HOP + FRAME) * DOWN // UP + 4 * DOWN
    parts = []
    for at in range(0, frames, PIECE):
        count = min(PIECE, frames - at)
        first, last = at * HOP, min(n, (at + count - 1) * HOP + FRAME)
        base = max(0, first // UP - TAPS) * DOWN  # a whole number of blocks before the piece
        x = samples[base : base + reach + 2 * TAPS * DOWN].astype(np.float32) / 128 - 1
        shift = base // DOWN * UP
        parts.append(log_mel(resample(x, first - shift, last - shift), frames=count))
    bands = np.concatenate(parts)
    return bands[:, :MELS], segments(bands[:, MELS])


def store_media(docs: DataFrame) -> DataFrame:
    """A stored table with doc_id, n_bytes and media (a WAV) of every document."""

    def run(batches):
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            media = [encode(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", "zstd")


#: Half floats: a log-mel value keeps three digits.
TENSOR = pa.fixed_shape_tensor(pa.float16(), (WINDOW, MELS), dim_names=("frame", "band"))
#: What is known of a document, in its first window; null in the others.
_ABOUT = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
WINDOWS = pa.schema([("doc_id", pa.int64()), ("window", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int32()), ("spans_ms", pa.list_(pa.list_(pa.float64()))), ("logmel", TENSOR), *_ABOUT])


def windows_of(doc, n_bytes: int, media: bytes) -> list[tuple]:
    """A medium's windows, as rows of WINDOWS; frames beyond the last are zero, spans stand where they begin."""
    payload = decode(media)
    bands, spans = analyze(payload)
    about = (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    rows = []
    for k, at in enumerate(range(0, len(bands), WINDOW)):
        part = bands[at : at + WINDOW]
        full = np.zeros((WINDOW, MELS), dtype=np.float16)
        full[: len(part)] = part
        inside = spans[(spans[:, 0] >= at) & (spans[:, 0] < at + WINDOW)] * STEP_MS
        rows.append((doc, k, at * STEP_MS, (at + len(part)) * STEP_MS, len(part), inside.tolist(), full, *(about if k == 0 else [None] * len(about))))
    return rows


def _table_of(rows: list[tuple]) -> pa.Table:
    at = WINDOWS.get_field_index("logmel")
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([r[at] for r in rows]), dim_names=list(TENSOR.dim_names))
    return pa.table([tensors if i == at else pa.array([r[i] for r in rows], f.type) for i, f in enumerate(WINDOWS)], schema=WINDOWS)


def store_features(media: DataFrame, folder: str, group: int = 512) -> DataFrame:
    """Writes a Parquet file of WINDOWS for each partition of media; a stored table with path and documents of each.

    The files' ``logmel`` is of Arrow's fixed-shape tensor type, for every reader of Arrow's schema.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        task, n, rows = TaskContext.get(), 0, []
        name = f"{root}/part-{task.partitionId():06d}.parquet"
        part = f"{name}.{task.taskAttemptId()}.tmp"
        with pq.ParquetWriter(part, WINDOWS, filesystem=fs, compression="zstd", use_dictionary=False, use_byte_stream_split=["logmel.list.element"]) as out:
            for batch in slices(batches, "media"):
                for doc, n_bytes, stored in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += windows_of(doc, n_bytes, stored)
                    n += 1
                    while len(rows) >= group:
                        out.write_table(_table_of(rows[:group]))
                        del rows[:group]
            if rows:
                out.write_table(_table_of(rows))
        if n:
            fs.move(part, name)
        else:
            fs.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([name] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], names=["path", "documents"])

    return table(media.select("doc_id", "n_bytes", "media").mapInArrow(run, "path string, documents long"), "features")


def read_windows(file) -> Iterator[pa.RecordBatch]:
    """The batches of a stored file, with its tensors."""
    with pq.ParquetFile(file) as parquet:
        if parquet.schema_arrow.field("logmel").type != TENSOR:
            raise ValueError("the filterbanks are not stored as tensors of the known shape")
        yield from parquet.iter_batches(batch_size=512)


class _Document:
    """What the windows of a document say, one after the other."""

    def __init__(self, doc, about):
        self.doc, self.about, self.frames, self.spans, self.voiced, self.sums = doc, about, 0, 0, 0.0, np.zeros(MELS)

    def add(self, frames: int, spans: list, logmel: np.ndarray) -> None:
        self.frames += frames
        self.spans += len(spans)
        self.voiced += sum(b - a for a, b in spans)
        self.sums += logmel[:frames].sum(axis=0, dtype=np.float64)

    def row(self) -> tuple:
        """Frames, spans, voiced milliseconds, and the mean of each band in tenths."""
        means = np.round(self.sums / self.frames * 10).astype(int)
        return self.doc, *self.about, f"frames={self.frames};spans={self.spans};voiced_ms={int(self.voiced)};mel={','.join(map(str, means))}"


_FEATURES = [("doc_id", pa.int64()), *_ABOUT, ("feature", pa.string())]


def read_features(files: DataFrame, folder: str) -> DataFrame:
    """One row for each document of store_features' files: what its media hold, and a feature string from its tensors."""
    n = max(1, files.count())

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                doc, rows = None, []
                with fs.open_input_file(path) as file:
                    for part in read_windows(file):
                        tensors = part.column("logmel").to_numpy_ndarray()
                        others = [part.column(k).to_pylist() for k in ("doc_id", "window", "frames", "spans_ms", *(k for k, _ in _ABOUT))]
                        for logmel, key, window, frames, spans, *about in zip(tensors, *others):
                            if window == 0:
                                rows += [doc.row()] if doc else []
                                doc = _Document(key, about)
                            doc.add(frames, spans, logmel)
                        yield batch_of(rows)
                        rows = []
                yield batch_of([doc.row()] if doc else [])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(_FEATURES)], names=[k for k, _ in _FEATURES])

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("path").repartition(n).mapInArrow(run, ddl)


def media_features(docs: DataFrame, folder: str) -> DataFrame:
    """The three steps: one row for each document, from its stored media and stored tensors."""
    return read_features(store_features(store_media(docs), folder), folder)
