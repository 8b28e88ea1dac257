"""Media columns: bytes stored as 8-bit PCM audio, and audio features read back from the stored form.

Storage is a WAV file (unsigned 8-bit mono). Features: polyphase resampling by ``UP / DOWN`` with a
windowed-sinc filter, overlapped Hann frames, log-mel filterbank energies, and segments found by hysteresis
on the frame energy (they start above the high threshold and last while it stays over the low one). The mel
frames are cut in tensors of a fixed shape (``FRAMES`` x ``MELS``, the last one zero-padded), each with its
time span.

Both are files of the shared folder. Stored media are a table; from its bytes, read back, tasks write Parquet files of features whose
tensors are lists of Arrow's fixed-shape tensor type, so that any Arrow reader gets them as arrays. Names are fresh, and only
files that committed tasks returned are read.

Defined cases: null and empty payloads are stored as 64 zero samples, every payload is padded to a multiple
of 64; null media count as those of an empty payload; a signal shorter than a frame is padded to one frame; silence has the floor's energy and no segment. Equal payloads give equal rows. Signals are processed in blocks, so length is bounded by the
payload itself alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hitwatch.llm import common

RATE = 16_000
UP, DOWN = 3, 4  # 16 kHz to 12 kHz
TAPS = 16  # a phase
FRAME, HOP, FFT = 300, 120, 512  # 25 and 10 ms at 12 kHz
MELS, FRAMES = 20, 64
BLOCK_FRAMES = 8192
HIGH_DB, LOW_DB = 1.5, 0.5  # against the signal's median frame energy
STEPS = 8  # stored units a decibel
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def pad(data: bytes, multiple: int = 64) -> bytes:
    """The bytes, with zeros up to a positive multiple."""
    return data + bytes(multiple * max(1, -(-len(data) // multiple)) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Lossless 8-bit mono WAV with a byte a sample."""
    return _WAV.pack(b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + bytes(len(payload) % 2)


def from_wav(data: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono WAV file, found chunk by chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(data):
                raise ValueError("damaged WAV file")
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV file without samples")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """Low-pass filter taps by output phase (UP x TAPS), each phase with unit gain."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    split = taps.reshape(TAPS, UP).T
    return (split / split.sum(1, keepdims=True)).astype("f4")


def resample(signal: np.ndarray) -> np.ndarray:
    """Polyphase resampling: output n takes the TAPS inputs up to n * DOWN // UP, filtered by phase n * DOWN % UP."""
    size = -(-len(signal) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS // 2, "f4"), signal, np.zeros(TAPS, "f4")])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(size, "f4")
    for first in range(UP):
        at, phase = first * DOWN // UP, first * DOWN % UP
        part = out[first::UP]
        part[:] = windows[at::DOWN][: len(part)] @ phases()[phase][::-1]
    return out


@lru_cache(maxsize=1)
def mel_bank() -> np.ndarray:
    """Triangular mel filters, (FFT / 2 + 1) x MELS."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1]))).astype("f4")


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and energies of frames, in steps of 1 / STEPS decibel."""
    n = 1 + max(0, len(signal) - FRAME + HOP - 1) // HOP
    padded = np.concatenate([signal, np.zeros((n - 1) * HOP + FRAME - len(signal), "f4")]) if (n - 1) * HOP + FRAME > len(signal) else signal
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype("f4")
    decibels = lambda x: np.round(STEPS * 10 * np.log10(np.maximum(x, 1e-6))).astype("i2")
    mels, energies = np.empty((n, MELS), "i2"), np.empty(n, "i2")
    for i in range(0, n, BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[i : i + BLOCK_FRAMES] * window, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype("f4")
        mels[i : i + BLOCK_FRAMES] = decibels(power @ mel_bank())
        energies[i : i + BLOCK_FRAMES] = decibels(frames[i : i + BLOCK_FRAMES].astype("f8").var(1))
    return mels, energies


def segments(energies: np.ndarray) -> np.ndarray:
    """Rows (first frame, frame after the last) of active segments by hysteresis against the median energy."""
    level = float(np.median(energies))
    high, low = energies > level + STEPS * HIGH_DB, energies > level + STEPS * LOW_DB
    edges = np.diff(np.concatenate([[0], low.astype("i1"), [0]]))
    spans = np.stack([np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)], axis=1)
    seen = np.concatenate([[0], np.cumsum(high)])
    return spans[seen[spans[:, 1]] > seen[spans[:, 0]]]


def features(wav: bytes) -> dict:
    """Tensors with their time spans, and active segments, of a stored WAV file."""
    _, samples = from_wav(wav)
    signal = resample((np.frombuffer(samples, "u1").astype("f4") - 128) / 128)
    mels, energies = log_mel(signal)
    active = segments(energies)
    count = -(-len(mels) // FRAMES)
    tensors = np.zeros((count * FRAMES, MELS), "<i2")
    tensors[: len(mels)] = mels
    ms = 1000 * HOP * DOWN // (RATE * UP)
    starts = np.arange(count) * FRAMES * ms
    ends = np.minimum(starts + FRAMES * ms, len(mels) * ms)
    return {"n_frames": len(mels), "tensors": tensors.reshape(count, FRAMES, MELS), "starts": starts, "ends": ends, "segments": active * ms}


def spans(starts: list[np.ndarray], ends: list[np.ndarray]) -> pa.ListArray:
    """List of (start_ms, end_ms) for each item of the lists."""
    flat = [np.concatenate([*part, np.zeros(0)]).astype("i8") for part in (starts, ends)]
    items = pa.StructArray.from_arrays([pa.array(f) for f in flat], names=["start_ms", "end_ms"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, starts)]), pa.int32()), items)


def tensor_lists(tensors: list[np.ndarray]) -> pa.ListArray:
    """A list of fixed-shape tensors for each item."""
    flat = np.concatenate([*tensors, np.zeros((0, FRAMES, MELS), "<i2")])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), FRAMES * MELS)
    typed = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.int16(), (FRAMES, MELS)), storage)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tensors)]), pa.int32()), typed)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each text's UTF-8 bytes as audio, written to the shared folder and read from there."""

    @F.arrow_udf("struct<n_bytes: bigint, media: binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, media = [], []
            for text in texts:  # one text at a time: a batch may hold long ones
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                media.append(to_wav(pad(raw)))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["n_bytes", "media"])
            pa.default_memory_pool().release_unused()

    return common.Stored(docs.select(F.col(id_col), encode(F.col(text_col)).alias("_m")).select(id_col, "_m.n_bytes", "_m.media"), "media").df


def feature_batch(ids: pa.Array, sizes: pa.Array, media: list[bytes | None]) -> pa.RecordBatch:
    """Facts of the samples read back from media, tensors with their spans, and active segments."""
    rows, found = [], []
    for item in media:
        wav = item or to_wav(pad(b""))
        _, samples = from_wav(wav)
        f = features(wav)
        rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), f["n_frames"]))
        found.append(f)
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames")
    facts = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    lists = [tensor_lists([f["tensors"] for f in found]), spans([f["starts"] for f in found], [f["ends"] for f in found]), spans([f["segments"][:, 0] for f in found], [f["segments"][:, 1] for f in found])]
    return pa.RecordBatch.from_arrays([ids, sizes, *facts, *lists], names=["id", "n_bytes", *names, "tensors", "spans", "segments"])


def write_features(stored: DataFrame, folder: str, *, id_col: str = "doc_id", media_col: str = "media", group_rows: int = 256, group_bytes: int = 4 << 20, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the features of stored media to Parquet files under ``folder``; rows (file, n_rows) of what was written."""
    rows = stored.select(F.col(id_col), "n_bytes", F.col(media_col))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, root = fs.FileSystem.from_uri(folder)
        writer, names, counts = None, [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and end - at < group_rows and (end == at or held < group_bytes):
                    held += batch.column(2)[end].as_buffer().size if batch.column(2)[end].is_valid else 0
                    end += 1
                made = feature_batch(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), [m.as_py() for m in batch.column(2).slice(at, end - at)])
                if writer is None:
                    names.append(f"part-{uuid.uuid4().hex}.parquet")
                    counts.append(0)
                    store_.create_dir(root, recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{names[-1]}", made.schema, filesystem=store_, compression="zstd")
                    written = 0
                writer.write_batch(made)
                counts[-1] += made.num_rows
                written += held
                at = end
                if written >= file_bytes:
                    writer.close()
                    writer = None
                del made
            pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "n_rows"])

    return common.Stored(rows.mapInArrow(put, "file string, n_rows long"), "features").df


def read_features(files: DataFrame, folder: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, rows: int = 256) -> DataFrame:
    """Rows that ``work`` makes of the batches of the listed feature files; the tensors arrive as fixed-shape tensor arrays."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store_.open_input_file(f"{root}/{name}") as source:
                    for read in pq.ParquetFile(source).iter_batches(batch_size=rows):
                        yield work(read)
                pa.default_memory_pool().release_unused()

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 20_000)).mapInArrow(take, schema)


def summary(read: pa.RecordBatch) -> pa.RecordBatch:
    """Checksums as they were stored, and the features as a short string: frames, tensors, segments, digests of segments and tensors."""
    lists, segments = read.column("tensors"), read.column("segments")
    if not isinstance(lists.values.type, pa.FixedShapeTensorType):
        raise ValueError(f"tensors are stored as {lists.values.type}")
    tensors = lists.values.to_numpy_ndarray()
    edges, cuts = lists.offsets.to_pylist(), segments.offsets.to_pylist()
    begins, ends = (segments.values.field(i).to_pylist() for i in range(2))
    made = []
    for i, n in enumerate(read.column("n_frames").to_pylist()):
        a, b, x, y = edges[i], edges[i + 1], cuts[i], cuts[i + 1]
        times = ",".join(f"{s}-{e}" for s, e in zip(begins[x:y], ends[x:y], strict=True))
        made.append(f"{n};{b - a};{y - x};{hashlib.sha256(times.encode()).hexdigest()};{hashlib.sha256(np.ascontiguousarray(tensors[a:b])).hexdigest()}")
    kept = ("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return pa.RecordBatch.from_arrays([*(read.column(c) for c in kept), pa.array(made, pa.string())], names=[*kept, "feature"])


def digests(stored: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Checksums of stored media, and their features read back from the files that they are written to under ``folder``."""
    files = write_features(stored, folder, id_col=id_col)
    kinds = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema = StructType([StructField("id", stored.schema[id_col].dataType), *StructType.fromDDL(kinds).fields])
    return read_features(files, folder, summary, schema).withColumnRenamed("id", id_col)
