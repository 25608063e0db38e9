"""Audio features: texts stored as 8-bit samples, resampled, log-mel frames as fixed-shape tensors, voiced segments.

A text's UTF-8 bytes, padded by zero bytes to a positive multiple of 64, are the samples of a mono 8-bit PCM WAV at
16 kHz. Features are computed from the stored bytes read back: a polyphase filter brings them to 12 kHz, overlapping
Hann-windowed frames give log-mel energies, these are cut into blocks of BLOCK frames (the last one padded), and
segments are the stretches that frame energy enters above a high and leaves below a low threshold.

Tensors go to Arrow files, one a task: a row for each block with its number, time span and fixed-shape tensor; a text's
first block also has its digests and segments. They are read back from there.

Scale: no shuffle of texts or tensors (the manifest, one row a file, is dealt over as many tasks); media are written once to the shared folder and read back by tasks that hold one batch
cut by bytes; frames of one text are computed in pieces of PIECE frames. Results for a text depend on that text alone.

Cases: null and empty texts are 64 zero bytes, one frame; columns other than doc_id and text are ignored; a null doc_id
stays null; repeated rows give repeated equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import materialize, shared_dir, slices

RATE, UP, DOWN = 16000, 3, 4
FRAME, HOP, FFT, MELS, BLOCK = 400, 160, 512, 32, 16
PIECE = 2048
HIGH_DB, LOW_DB = 1.0, 0.25
FLOOR = 1e-6


def to_media(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its WAV."""
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = data + bytes(-len(data) % 64 or (0 if data else 64))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return len(data), head + payload


def samples_of(media: bytes) -> bytes:
    """The data chunk of a WAV."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed sinc at the lower of both Nyquist rates, 2 * half lobes, gain `up`."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hanning(n)
    return (h / h.sum() * up).astype("f4")


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: np.ndarray | None = None) -> np.ndarray:
    """Rational resampling: each output takes the branch of the filter of its own phase, so nothing is computed to be dropped."""
    h = low_pass(up, down) if taps is None else taps
    half, n_out = len(h) // 2, -(-len(x) * up // down)
    k = -(-len(h) // up)
    out = np.zeros(n_out, "f4")
    padded = np.concatenate([np.zeros(k, "f4"), x, np.zeros(k + half, "f4")])
    windows = np.lib.stride_tricks.sliding_window_view(padded, k)
    for first in range(min(up, n_out)):  # outputs first, first + up, ... share a phase
        m = first * down + half
        branch = h[m % up :: up]
        branch = np.concatenate([branch, np.zeros(k - len(branch), "f4")])[::-1]
        count = -(-(n_out - first) // up)
        begin = m // up + 1
        out[first::up] = windows[begin : begin + (count - 1) * down + 1 : down] @ branch
    return out


def mel_bank(rate: float = RATE * UP / DOWN, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """(bins, mels) triangles evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype("f4")


def log_mel(y: np.ndarray, bank: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies and (frames,) energy in dB; the tail is padded to a whole frame."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), "f4")])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, db = np.empty((n, len(bank[0])), "f4"), np.empty(n, "f4")
    for a in range(0, n, PIECE):
        part = frames[a : a + PIECE] * window
        spec = np.fft.rfft(part, FFT)
        mel[a : a + PIECE] = np.log((spec.real**2 + spec.imag**2).astype("f4") @ bank + FLOOR)
        db[a : a + PIECE] = 10 * np.log10((part * part).mean(1) + FLOOR)
    return mel, db


def hysteresis(db: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """[begin, end) of frames: on when above `high`, off when below `low`, else as before."""
    event = np.where(db > high, 1, np.where(db < low, -1, 0))
    last = np.maximum.accumulate(np.where(event, np.arange(len(db)), 0))
    on = np.concatenate([[False], event[last] == 1, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [to_media(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    used = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialize(used.mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"))


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, shape array<int>, tensor binary, block_ms array<struct<start:int,end:int>>, segment_ms array<struct<start:int,end:int>>"


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NAMES = [x.split()[0] for x in FEATURES.replace("struct<start:int,end:int>", "").split(", ")]
#: What a text's first block carries besides.
META = (*NAMES[:6], "segment_ms")


def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and FEATURES of doc_id, n_bytes, media."""
    ms = 1000 * HOP * DOWN / (RATE * UP)
    bank, window, taps = mel_bank(), np.hanning(FRAME).astype("f4"), low_pass(UP, DOWN)
    span = lambda pairs: [{"start": round(a * ms), "end": round(b * ms)} for a, b in pairs]
    for batch in slices(batches, "media"):
        cols: list[list] = [[] for _ in range(9)]
        for media in batch.column("media").to_pylist():
            payload = samples_of(media)
            mel, db = log_mel(resample((np.frombuffer(payload, "u1").astype("f4") - 128) / 128, taps=taps), bank, window)
            blocks = -(-len(mel) // BLOCK)
            tensor = np.full((blocks * BLOCK, MELS), np.log(FLOOR), "f2")
            tensor[: len(mel)] = mel
            mid = float(np.median(db))
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), [blocks, BLOCK, MELS], tensor.tobytes(), span((i * BLOCK, min(len(mel), (i + 1) * BLOCK)) for i in range(blocks)), span(hysteresis(db, mid + HIGH_DB, mid + LOW_DB)))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), SPANS, SPANS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *NAMES])


def features(media: DataFrame) -> DataFrame:
    """doc_id, digests of the stored bytes, tensor (float16, of shape blocks x BLOCK x MELS) and time spans in ms."""
    return media.mapInArrow(compute, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def store_tensors(media: DataFrame, out: str | None = None) -> DataFrame:
    """Writes the Arrow files of the features of media under `out` (default: the shared folder); path, root and n_blocks of each."""
    out = out or shared_dir(media.sparkSession)

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([x[0] for x in batch.column("shape").to_pylist()])
        doc = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = pa.array(doc, mask=number > 0)
        spans = batch.column("block_ms").flatten()
        flat = pa.array(np.frombuffer(b"".join(batch.column("tensor").to_pylist()), "f2"))
        tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), (BLOCK, MELS)), pa.FixedSizeListArray.from_arrays(flat, BLOCK * MELS))
        cols = {"doc_id": batch.column("doc_id").take(pa.array(doc)), **{c: batch.column(c).take(first) for c in META}}
        cols |= {"block": pa.array(number, pa.int32()), "start_ms": spans.field("start"), "end_ms": spans.field("end"), "tensor": tensor}
        return pa.record_batch(cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        path, f, w, rows = f"{root}/tensors-{uuid.uuid4().hex}.arrow", None, None, 0
        for batch in compute(batches):
            part = blocks(batch)
            if w is None:
                f = fs.open_output_stream(f"{path}.open")
                w = pa.ipc.new_file(f, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            w.write_batch(part)
            rows += part.num_rows
        if w is None:
            return
        w.close()
        f.close()
        fs.move(f"{path}.open", path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out]), pa.array([rows], pa.int64())], ["path", "root", "n_blocks"])

    return materialize(media.mapInArrow(write, "path string, root string, n_blocks long"))


def read_tensors(files: DataFrame, doc_id: str = "long") -> DataFrame:
    """doc_id (of the given type) and FEATURES, from the rows of store_tensors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, root in zip(batch.column("path").to_pylist(), batch.column("root").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(root)
                with fs.open_input_file(path) as f, pa.ipc.open_file(f) as stored:
                    for k in range(stored.num_record_batches):
                        yield whole(stored.get_batch(k))

    def whole(part: pa.RecordBatch) -> pa.RecordBatch:
        first = np.flatnonzero(part.column("block").to_numpy() == 0)
        ends = [*first[1:].tolist(), part.num_rows]
        data, size = part.column("tensor").storage.flatten().to_numpy(zero_copy_only=False), BLOCK * MELS
        spans = pa.StructArray.from_arrays([part.column("start_ms"), part.column("end_ms")], ["start", "end"])
        at = pa.array(first)
        cols = {"doc_id": part.column("doc_id").take(at), **{c: part.column(c).take(at) for c in META}}
        cols["shape"] = pa.array([[e - b, BLOCK, MELS] for b, e in zip(first.tolist(), ends, strict=True)], pa.list_(pa.int32()))
        cols["tensor"] = pa.array([data[b * size : e * size].tobytes() for b, e in zip(first.tolist(), ends, strict=True)], pa.binary())
        cols["block_ms"] = pa.ListArray.from_arrays(pa.array([*first.tolist(), part.num_rows], pa.int32()), spans)
        return pa.record_batch({c: cols[c] for c in ("doc_id", *NAMES)})

    return files.repartitionByRange(max(1, files.count()), "path").mapInArrow(read, f"doc_id {doc_id}, {FEATURES}")


def digest(found: DataFrame) -> DataFrame:
    """Of features: the digest columns, `feature`, which names shape, segments and the tensor's hash, and the segments' time spans."""
    parts = F.concat_ws(":", F.array_join(F.col("shape").cast("array<string>"), "x"), F.size("segment_ms").cast("string"), F.aggregate("segment_ms", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("string"), F.sha2("tensor", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", parts.alias("feature"), F.array_join(F.transform("segment_ms", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("segment_ms"))
