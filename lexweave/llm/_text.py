"""Vectorised word kernel shared by the text operators of this subpackage.

Everything here works on whole Arrow batches: words are located by byte class
and hashed eight bytes at a time with numpy, so no Python object is made per
word.  A *word* is a maximal run of ASCII letters/digits or non-ASCII bytes
(``ALNUM``), or a maximal run of anything but ASCII whitespace (``NONSPACE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_b = np.arange(256)
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
NONSPACE = _b > 32

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x = x * M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts: byte spans in ``data`` and, per text, the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray  # len(texts) + 1

    @property
    def n_docs(self) -> int:
        return len(self.off) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs, dtype=np.int64), np.diff(self.off))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self.start)
        h = np.full(n, (0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1), dtype=np.uint64)
        if not n:
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at8 = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.end - self.start
        h ^= length.astype(np.uint64) * M2
        live, pos = slice(None), self.start
        left = length
        while True:
            chunk = at8[pos]
            short = left < 8
            if short.any():
                bits = np.where(short, left * 8, 0).astype(np.uint64)
                chunk = np.where(short, chunk & ((np.uint64(1) << bits) - np.uint64(1)), chunk)
            h[live] = mix(h[live] ^ chunk) * M1
            more = np.flatnonzero(left > 8)
            if not len(more):
                return mix(h)
            live = more if isinstance(live, slice) else live[more]
            pos, left = pos[more] + 8, left[more] - 8


def find_words(texts: pa.Array, table: np.ndarray = ALNUM, lower: bool = False) -> Words:
    """Words of each text; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.utf8_lower(texts)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    isw = table[data]
    prev = np.empty(len(data) + 1, bool)
    prev[0], prev[1:] = False, isw
    prev[off] = False  # words end where their text ends
    start = np.flatnonzero(isw & ~prev[:-1])
    nxt = np.empty(len(data) + 1, bool)
    nxt[-1], nxt[:-1] = False, isw
    nxt[off] = False
    end = np.flatnonzero(isw & ~nxt[1:]) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


ROLL = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
ROLL_INV = pow(ROLL, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[i]*ROLL**i and inverse powers, for :func:`span_hash`."""
    g = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(ROLL, len(h)), out=g[1:])
    return g, _powers(ROLL_INV, len(h) + 1)


def span_hash(g: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1; equal word sequences have equal hashes wherever they stand."""
    return mix((g[end] - g[start]) * inv[start])


def stable_hash(word: str, seed: int = 0) -> int:
    """The hash that :meth:`Words.hashes` gives this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0]), np.array([len(raw)]), np.array([0, 1])).hashes(seed)[0])
