"""Media columns: audio features.

A text column's bytes are kept losslessly as 8-bit PCM in a WAV container; from the container read back come
a polyphase-resampled signal, overlapped log-mel filterbanks cut into fixed-shape tensors, and segments found by
an energy threshold with hysteresis, each with its time span.

Cases: null and empty values become 64 zero samples (one silent frame); long values are
resampled and transformed in blocks of frames, and their features, about 15 bytes a byte of the value, are kept whole; equal values give equal features; an empty table gives an
empty result; only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

QUANTUM = 64


@dataclass(frozen=True)
class AudioSpec:
    """Shape of the features. up/down: the resampling ratio; frame and hop in resampled samples."""

    rate: int = 8000
    up: int = 2
    down: int = 5
    taps: int = 24
    frame: int = 128
    hop: int = 64
    mels: int = 24
    patch: int = 16
    high: float = 0.6
    low: float = 0.15
    block: int = 8192

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def wav_bytes(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM in RIFF/WAVE: each payload byte is one sample."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n + (n & 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload + b"\0" * (n & 1)


def wav_payload(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("only 8-bit mono is kept here")
        elif kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % QUANTUM if raw else QUANTUM), len(raw)


class Features:
    """Filters of one AudioSpec and the feature computation."""

    def __init__(self, spec: AudioSpec = AudioSpec()):
        self.spec = s = spec
        cut = min(1 / s.up, 1 / s.down)
        n = s.taps * s.up
        t = np.arange(n) - (n - 1) / 2
        proto = (np.sinc(t * cut) * np.hamming(n) * cut * s.up).astype(np.float32)
        # Output j of each group of `up` lies at input j * down / up; its taps are one phase of the prototype.
        self.span = s.taps + (s.up - 1) * s.down // s.up
        bank = np.zeros((self.span, s.up), np.float32)
        for j in range(s.up):
            base, phase = divmod(j * s.down, s.up)
            bank[base : base + s.taps, j] = proto[phase :: s.up][::-1][: s.taps]
        self.bank = bank
        self.window = np.hanning(s.frame).astype(np.float32)
        hz = np.linspace(0, s.out_rate / 2, s.frame // 2 + 1)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(s.out_rate / 2), s.mels + 2) / 2595) - 1)
        lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
        self.mel = np.maximum(0, np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))).T.astype(np.float32)

    def resample(self, x: np.ndarray) -> np.ndarray:
        """x with span - 1 samples of context behind it -> len // down * up outputs."""
        s = self.spec
        groups = max(0, (len(x) - self.span) // s.down + 1)
        rows = np.lib.stride_tricks.as_strided(x, (groups, self.span), (x.strides[0] * s.down, x.strides[0]))
        return (np.ascontiguousarray(rows) @ self.bank).ravel()

    def frames(self, n: int) -> int:
        s = self.spec
        out = -(-n // s.down) * s.up
        return max(1, -(-max(0, out - s.frame) // s.hop) + 1)

    def blocks(self, samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(log-mel, energy) of up to `block` frames at a time; uint8 samples."""
        s = self.spec
        total = self.frames(len(samples))
        per = s.hop * s.down // s.up  # input samples a hop; hop is a multiple of up
        need = -(-s.frame // s.up) * s.down + self.span
        for a in range(0, total, s.block):
            k = min(s.block, total - a)
            part = samples[a * per : a * per + (k - 1) * per + need]
            x = (part.astype(np.float32) - 128) / 128
            if len(x) < (k - 1) * per + need:
                x = np.concatenate([x, np.zeros((k - 1) * per + need - len(x), np.float32)])
            y = self.resample(x)
            f = np.lib.stride_tricks.as_strided(y, (k, s.frame), (y.strides[0] * s.hop, y.strides[0])) * self.window
            z = np.fft.rfft(f)
            power = z.real**2 + z.imag**2
            yield np.log(power.astype(np.float32) @ self.mel + np.float32(1e-6)), (f * f).mean(axis=1)

    def segments(self, energy: np.ndarray) -> list[tuple[int, int]]:
        """Frames [a, b) from where the energy passes the high threshold to where it falls under the low one. The thresholds lie between the quiet and the loud end of the value itself."""
        s = self.spec
        ranked = np.sort(energy)
        lo, hi = ranked[len(ranked) // 20], ranked[-1 - len(ranked) // 20]
        mark = np.zeros(len(energy), np.int8)
        mark[energy >= lo + s.high * (hi - lo)] = 1
        mark[energy < lo + s.low * (hi - lo)] = -1
        if hi - lo < 1e-9:
            return []
        at = np.where(mark != 0, np.arange(len(mark)), -1)
        last = np.maximum.accumulate(at)
        on = np.where(last >= 0, mark[np.maximum(last, 0)], -1) > 0
        edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


TENSOR_COLUMNS = "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, tensors binary, mel_mean array<float>, spans array<struct<start_s:double,end_s:double>>"


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: AudioSpec = AudioSpec()) -> DataFrame:
    """One row per row of df: id_col, the stored medium, and the features of the medium read back.

    tensors is an Arrow IPC stream (Spark has no tensor type of its own) of columns patch, start_s and end_s: patch is of
    Arrow's fixed-shape tensor type, [spec.patch, spec.mels] floats, one row a patch in time order, with its time span in
    seconds; the last one is filled with its silent floor. `read_tensors` gives it back as a table. mel_mean is computed
    from what is read back. spans are the segments in seconds.
    """
    src = common.ids_and_text(df, id_col, text_col)
    kind = src.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, {TENSOR_COLUMNS}"

    def run(batches):
        common.env_threads()
        feats, s = Features(spec), spec
        out = None
        floor = np.float32(np.log(np.float32(1e-6)))
        span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
        for batch in batches:
            if out is None:
                out = common.Out(pa.schema([("_id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("n_frames", pa.int64()), ("tensors", pa.binary()), ("mel_mean", pa.list_(pa.float32())), ("spans", pa.list_(span))]))
            for key, text in common.text_rows(batch):
                raw, n = padded(text)
                media = wav_bytes(raw, s.rate)
                payload, _ = wav_payload(media)
                mels, energies = zip(*feats.blocks(np.frombuffer(payload, np.uint8)))
                mel, energy = np.concatenate(mels), np.concatenate(energies)
                patches = -(-len(mel) // s.patch)
                whole = np.full((patches * s.patch, s.mels), floor, np.float32)
                whole[: len(mel)] = mel
                step = s.hop / s.out_rate
                spans = [{"start_s": a * step, "end_s": b * step} for a, b in feats.segments(energy)]
                stored = write_tensors(whole.reshape(patches, s.patch, s.mels), s)
                back = tensor_values(read_tensors(stored)).reshape(-1, s.mels)[: len(mel)]
                out.add((key, n, media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(mel), stored, back.mean(axis=0), spans), len(media) + len(stored))
                if out.full():
                    yield out.take()
        if out is not None and out.cols[0]:
            yield out.take()

    return src.mapInArrow(common.tidy(run), schema).withColumnRenamed("_id", id_col)


def write_tensors(patches: np.ndarray, spec: AudioSpec = AudioSpec()) -> bytes:
    """An Arrow IPC stream of [n, patch, mels] floats as fixed-shape tensors with their time spans."""
    n = len(patches)
    kind = pa.fixed_shape_tensor(pa.float32(), (spec.patch, spec.mels))
    values = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(patches.ravel()), spec.patch * spec.mels))
    start = np.arange(n) * (spec.patch * spec.hop / spec.out_rate)
    batch = pa.RecordBatch.from_arrays([values, pa.array(start), pa.array(start + spec.patch * spec.hop / spec.out_rate)], ["patch", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """patch (fixed-shape tensors), start_s, end_s of a value of the tensors column."""
    with pa.ipc.open_stream(stored) as r:
        return r.read_all()


def tensor_values(table: pa.Table) -> np.ndarray:
    """[n, patch, mels] floats of a table of read_tensors."""
    return table.column("patch").combine_chunks().to_numpy_ndarray()


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    """The digests of the contract, derived from the operator's media, tensors and spans."""
    s = AudioSpec()
    f = audio_features(common.documents(spark, sf_dir), spec=s).withColumn("n_patches", F.ceil(F.col("n_frames") / s.patch))
    centi = lambda v: F.round(v * 100).cast("long").cast("string")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", centi(s["start_s"]), centi(s["end_s"]))), ",")
    mean = F.array_join(F.transform("mel_mean", centi), ",")
    feature = F.concat(F.lit("frames="), F.col("n_frames"), F.lit(";tensors="), F.col("n_patches"), F.lit(";segments="), F.size("spans"), F.lit(";spans="), F.md5(spans.cast("binary")), F.lit(";mel="), mean)
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "n_frames", F.size("spans").cast("long").alias("n_segments"))
