"""Whole Arrow batches of text as numpy arrays.

The operators tokenise millions of texts.  Doing that one Python object at a
time costs microseconds a word, so a batch is read straight from Arrow's
buffers: word borders come from a lookup table over the bytes, and each word
or line gets a 64-bit polynomial hash from prefix sums.  Work is cut into
slices of bounded bytes, so memory does not depend on the size of a batch.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps
those bytes out of multi-byte characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and a space for every ASCII character but letters and digits.
FOLDED = np.array([LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for ascending, disjoint segments."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + block, "right")))
        hi = int(ends[to - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _power(_INVERSE, hi - lo + 1)[s]
        at = to
    return mix(out)


def hash_of(data: bytes) -> int:
    """The hash that segment_hashes gives these bytes."""
    return int(segment_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the borders between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    borders = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[borders[0] : borders[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` text bytes, one row at least."""
    for batch in batches:
        _, borders = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, where it can give memory back."""
    try:
        lib = ctypes.CDLL(None)
        lib.malloc_trim  # noqa: B018 - absent outside glibc
    except (OSError, AttributeError):
        return None
    return lib


def lean() -> None:
    """Give freed memory back to the system: workers live on, and their heap counts against the executor."""
    pa.default_memory_pool().release_unused()
    if lib := _libc():
        lib.malloc_trim(0)


@dataclass
class Words:
    """The words of a slice: byte borders, hashes, and each text's range of words."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has words first[i] .. first[i + 1] - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array, mapped: np.ndarray | None = None, hashed: bool = True) -> Words:
    """mapped: a table of 256 bytes through which the text goes first, such as LOWER."""
    buf, borders = raw(column)
    if mapped is not None:
        buf = mapped[buf]
    start, end = runs(~IS_SPACE[buf], borders)
    hashes = segment_hashes(buf, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(buf, start, end, hashes, np.searchsorted(start, borders))


def runs(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a border."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[borders] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring borders."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[borders[1:]] - sums[borders[:-1]]
