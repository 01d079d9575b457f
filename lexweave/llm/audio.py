"""Audio features as media columns: resampling, log-mel patches and energy segments.

``Resampler`` changes the rate by up/down with a windowed-sinc low-pass held as
``up`` polyphase branches, so only the samples that stay are computed; runs of
outputs are one product with a band of the branches.
``log_mel`` takes overlapped Hann frames to log filterbank energies.
``segments`` marks sound by energy with hysteresis: it begins where the level
reaches ``high`` dB and lasts while it stays at ``low`` dB or more.  The last
frame is filled up with zeros, so that every sample is in a frame.

:func:`audio_features` cuts each clip into patches of FRAMES x MELS and stores
each as a list of that fixed length, row by row.  The column says so in its
metadata in the terms of Arrow's fixed-shape tensors; :func:`read_tensors` reads
the Parquet files with the column as such tensors, :func:`as_tensors` converts
an Arrow table.  Each patch has its time span and the number of real frames
(the rest is padding at the floor); the segments of sound that meet its span go
with it.

A clip is worked off in slices of ``SLICE`` samples, of which only the filterbank
energies stay, so a clip of an hour takes some 60 MB besides its samples.

Defined results: null, empty and non-finite-only audio gives no patch; non-finite
samples count as 0; a clip shorter than a frame is padded to one; a rate that
is null or not positive gives no patch.  Repeated rows each give their patches;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, FRAME, HOP, FFT, MELS, FRAMES = 16000, 400, 160, 512, 40, 32
HIGH_DB, LOW_DB, FLOOR = -30.0, -40.0, 1e-10
#: samples worked off at once, and patches in a batch of results
SLICE, PATCHES = 1 << 17, 256
#: stored with the column, as Arrow's canonical extension type has it
TENSOR = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": f'{{"shape":[{FRAMES},{MELS}]}}'}


@functools.lru_cache(maxsize=64)
def branches(up: int, down: int, half: int = 12) -> np.ndarray:
    """Polyphase branches of the low-pass: row p has the taps that meet an output of phase p, latest input first."""
    wide = half * max(1.0, down / up)
    taps = 2 * math.ceil(wide) + 1
    t = (np.arange(up)[:, None] / up) + np.arange(taps)[None, :] - taps // 2
    cut = min(1.0, up / down)
    window = np.where(np.abs(t) <= wide, 0.5 + 0.5 * np.cos(np.pi * np.clip(t / wide, -1, 1)), 0.0)
    h = cut * np.sinc(cut * t) * window
    return h / h.sum(axis=1, keepdims=True)  # each branch passes a constant unchanged


class Resampler:
    """From ``rate`` to ``to``; output n stands at time n / to and meets the inputs around n * down / up."""

    def __init__(self, rate: int, to: int = RATE, run: int = 64):
        g = math.gcd(rate, to)
        self.up, self.down = to // g, rate // g
        h = branches(self.up, self.down)
        self.taps = h.shape[1]
        self.period = self.up * max(1, run // self.up)  # outputs that repeat with a step of whole inputs
        self.step = self.period // self.up * self.down
        self.bands = []  # (first output, first input, inputs x outputs) of each run of outputs in a period
        for i in range(0, self.period, run):
            at = np.arange(i, min(i + run, self.period)) * self.down
            base = at // self.up
            band = np.zeros((int(base[-1] - base[0]) + self.taps, len(at)), np.float32)
            for j, (b, p) in enumerate(zip(base - base[0], at % self.up, strict=True)):
                band[b : b + self.taps, j] = h[p, ::-1]
            self.bands.append((i, int(base[0]), band))

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def piece(self, x: np.ndarray, first: int, count: int) -> np.ndarray:
        """Outputs of periods ``first`` to ``first + count``, of the whole signal ``x``."""
        low, need = first * self.step - self.taps // 2, (count + 1) * self.step + 2 * self.taps
        part = np.zeros(need, np.float32)
        a, b = max(0, low), min(len(x), low + need)
        if b > a:
            part[a - low : b - low] = samples(x[a:b])
        out = np.empty((count, self.period), np.float32)
        for i, base, band in self.bands:
            view = np.lib.stride_tricks.as_strided(part[base:], (count, len(band)), (4 * self.step, 4))
            out[:, i : i + band.shape[1]] = view @ band
        return out.ravel()


@functools.lru_cache(maxsize=64)
def resampler(rate: int, to: int = RATE) -> Resampler:
    return Resampler(rate, to)


def samples(x: np.ndarray) -> np.ndarray:
    """Samples as numbers from -1 to 1; non-finite ones are 0."""
    if x.dtype.kind == "i":
        return x.astype(np.float32) / np.float32(32768)
    return np.nan_to_num(x.astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0)


def resampled(x: np.ndarray, rate: int, to: int = RATE, most: int = SLICE) -> Iterator[np.ndarray]:
    """The signal ``x`` at rate ``to``, in slices of about ``most`` samples."""
    if rate == to:
        for i in range(0, len(x), most):
            yield samples(x[i : i + most])
        return
    r = resampler(rate, to)
    left, per, first = r.length(len(x)), max(1, most // r.period), 0
    while left > 0:
        count = min(per, -(-left // r.period))
        yield r.piece(x, first, count)[:left]
        left, first = left - count * r.period, first + count


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """``x`` at rate ``to``; output n stands at time n / to."""
    return np.concatenate([np.zeros(0, np.float32), *resampled(x, rate, to)])


@functools.lru_cache(maxsize=4)
def filterbank(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular mel filters, one a column."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1]))).astype(np.float32)


def n_frames(n: int) -> int:
    """Frames of ``n`` samples, the last filled up."""
    return 1 + max(0, -(-(n - FRAME) // HOP))


def frames_of(x: np.ndarray) -> np.ndarray:
    short = (n_frames(len(x)) - 1) * HOP + FRAME - len(x)
    x = np.concatenate([x, np.zeros(short, x.dtype)])
    return np.lib.stride_tricks.as_strided(x, (n_frames(len(x)), FRAME), (HOP * x.itemsize, x.itemsize), writeable=False)


class Bench:
    """Memory for a block of frames, used again for each (a worker has one thread)."""

    def __init__(self, most: int = 128):
        self.most = most
        self.window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)
        self.padded = np.zeros((most, FFT), np.float32)
        self.spectrum = np.empty((most, FFT // 2 + 1), np.complex64)
        self.power = np.empty((most, FFT // 2 + 1), np.float32)
        self.square = np.empty((most, FFT // 2 + 1), np.float32)

    def log_mel(self, frames: np.ndarray) -> np.ndarray:
        out = np.empty((len(frames), MELS), np.float32)
        for i in range(0, len(frames), self.most):
            n = min(self.most, len(frames) - i)
            np.multiply(frames[i : i + n], self.window, out=self.padded[:n, :FRAME])
            f = np.fft.rfft(self.padded[:n], axis=1, out=self.spectrum[:n])
            np.square(f.real, out=self.power[:n])
            np.square(f.imag, out=self.square[:n])
            self.power[:n] += self.square[:n]
            np.matmul(self.power[:n], filterbank(), out=out[i : i + n])
        np.maximum(out, np.float32(FLOOR), out=out)
        return np.log(out, out=out)


@functools.lru_cache(maxsize=1)
def bench() -> Bench:
    return Bench()


def log_mel(frames: np.ndarray) -> np.ndarray:
    return bench().log_mel(frames)


def level(frames: np.ndarray) -> np.ndarray:
    """Level of each frame in dB."""
    return 10 * np.log10(np.maximum(np.einsum("ij,ij->i", frames, frames) / FRAME, FLOOR))


def segments(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Frame ranges of sound by the frames' levels, end excluded."""
    on = np.concatenate([[False], db >= low, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if (db[a:b] >= high).any()]


def analysed(x: np.ndarray, rate: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Samples after resampling, log-mel energies and levels of all frames, slice by slice."""
    n, kept, mels, dbs = 0, np.zeros(0, np.float32), [], []
    for y in resampled(x, rate):
        n += len(y)
        kept = np.concatenate([kept, y])
        whole = (len(kept) - FRAME) // HOP + 1 if len(kept) >= FRAME else 0
        if whole > 1:  # the last frame waits: it may be the end
            f = frames_of(kept[: (whole - 2) * HOP + FRAME])
            mels.append(log_mel(f))
            dbs.append(level(f))
            kept = kept[(whole - 1) * HOP :]
    f = frames_of(kept)
    return n, np.concatenate([*mels, log_mel(f)]), np.concatenate([*dbs, level(f)])


def patches(x: np.ndarray, rate: int | None) -> Iterator[tuple[int, float, float, int, np.ndarray, list[dict]]]:
    """Number, start, end, real frames, values and segments of each patch of a clip."""
    if rate is None or rate <= 0 or not len(x) or x.dtype.kind == "f" and not np.isfinite(x).any():
        return
    total, mel, db = analysed(x, int(rate))
    length, sound = total / RATE, segments(db)
    ends, s = [b for _, b in sound], 0
    for i in range(0, len(mel), FRAMES):
        n = min(FRAMES, len(mel) - i)
        full = np.full((FRAMES, MELS), np.float32(math.log(FLOOR)), np.float32)
        full[:n] = mel[i : i + n]
        while s < len(ends) and ends[s] <= i:
            s += 1
        mine, k = [], s
        while k < len(sound) and sound[k][0] < i + n:
            a, b = sound[k]
            mine.append({"t_start": max(a, i) * HOP / RATE, "t_end": min(length, ((min(b, i + n) - 1) * HOP + FRAME) / RATE)})
            k += 1
        yield i // FRAMES, i * HOP / RATE, min(length, ((i + n - 1) * HOP + FRAME) / RATE), n, full.ravel(), mine


def pcm(cell: bytes) -> np.ndarray:
    """Samples of 16-bit little-endian PCM; an odd last byte is left out."""
    return np.frombuffer(cell, "<i2", len(cell) // 2)


_SOUND = pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())]))


def _batch(part: pa.RecordBatch, keys: list[str], rows: list[int], got: list[tuple]) -> pa.RecordBatch:
    values = np.concatenate([g[4] for g in got]) if got else np.zeros(0, np.float32)
    mel = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * (FRAMES * MELS)), pa.array(values))
    cols = [part.column(k).take(pa.array(rows, pa.int64())) for k in keys]
    cols += [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int32()), mel, pa.array([g[5] for g in got], _SOUND)]
    return pa.RecordBatch.from_arrays(cols, [*keys, "patch", "t_start", "t_end", "n_frames", "log_mel", "sound"])


def audio_features(clips: DataFrame, keys: list[str], media: str = "samples", rate: str = "rate", decode: Callable[[object], np.ndarray] = pcm) -> DataFrame:
    """One row a patch: ``keys``, ``patch, t_start, t_end, n_frames, log_mel, sound``.

    ``decode`` makes samples of a cell of ``media``, one cell at a time: by default
    of binary 16-bit little-endian PCM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, rates = b.column(media), b.column(rate)
            rows: list[int] = []
            got: list[tuple] = []
            for r in range(b.num_rows):
                cell, hz = cells[r].as_py(), rates[r].as_py()
                for p in patches(decode(cell), hz) if cell is not None else ():
                    rows.append(r)
                    got.append(p)
                    if len(got) == PATCHES:
                        yield _batch(b, keys, rows, got)
                        rows, got = [], []
            if got:
                yield _batch(b, keys, rows, got)

    types = ", ".join(f"`{k}` {clips.schema[k].dataType.simpleString()}" for k in keys)
    out = clips.select(*keys, media, rate).mapInArrow(run, f"{types}, patch int, t_start double, t_end double, n_frames int, log_mel array<float>, sound array<struct<t_start:double,t_end:double>>")
    return out.withColumn("log_mel", F.col("log_mel").alias("log_mel", metadata=TENSOR))


def as_tensors(table: pa.Table, column: str = "log_mel") -> pa.Array:
    """The column as an Arrow array of fixed-shape tensors."""
    flat = table.column(column).combine_chunks()
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten(), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), storage)


def read_tensors(path: str, column: str = "log_mel") -> Iterator[pa.RecordBatch]:
    """Batches of written features, with the column as fixed-shape tensors."""
    for b in ds.dataset(path).to_batches():
        if b.num_rows:
            at = b.schema.get_field_index(column)
            yield b.set_column(at, pa.field(column, pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), as_tensors(pa.Table.from_batches([b]), column))


def voice(text: str, per_char: int = 16) -> np.ndarray:
    """A voice to test with: each character sounds for ``per_char`` samples as a tone of its own, blanks and signs are silent."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return _tones(per_char)[np.where((c >= 97) | ((c >= 48) & (c < 58)), c % 32, 32)].ravel()


@functools.lru_cache(maxsize=4)
def _tones(per_char: int) -> np.ndarray:
    tones = np.sin(2 * np.pi * (0.02 + np.arange(32)[:, None] * 0.01) * np.arange(per_char)) * 0.5 * 32767
    return np.concatenate([tones, np.zeros((1, per_char))]).astype(np.int16)


def voiced_features(turns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Features of the synthetic voices of texts, since the tables here have no sound; a role other than ``user`` has a rate of 11025 Hz, ``user`` 8000."""
    rate = F.when(F.col("role") == "user", 8000).otherwise(11025)
    return audio_features(turns.select(*keys, F.col(text).alias("samples"), rate.alias("rate")), keys, decode=voice)
