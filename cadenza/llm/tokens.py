"""Vectorised words of Arrow string columns: byte offsets, 64-bit word hashes and hashes of word windows.

Texts are handled in chunks of a megabyte, so a task's memory depends on the chunk and on its
longest single text, never on the number of rows. Hashes only find candidates or key groups; callers
that need certainty compare the words or use two independent hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_WINDOW_ODD = U64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor, shift, multiply)."""
    x = x.astype(U64, copy=True)
    x += U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(odd: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and its inverse modulo 2**64 for i < n (kept per process, grown by doubling)."""
    key = int(odd)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = U64(pow(key, -1, 1 << 64))
        forward, backward = np.full(size, odd, U64), np.full(size, inverse, U64)
        forward[0] = backward[0] = 1
        _POWERS[key] = np.multiply.accumulate(forward), np.multiply.accumulate(backward)
    return _POWERS[key]


_BYTE_CODE = mix(np.arange(256, dtype=U64), 7)

#: Words are runs of anything but space and the controls 09 to 0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of digits, ASCII letters and every non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def give_back() -> None:
    """Memory that this process freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow: after a task's last batch its Python worker, which lives on, gives freed memory back."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        _POWERS.clear()
        give_back()

    return task


class Words:
    """The words of consecutive texts: `start`, `end` (byte offsets into `data`), `hash`, and `first[i]:first[i+1]` per text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data, self.bounds = data, bounds
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = word[data]
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        starts[cuts] = inside[1:-1][cuts]
        ends[cuts - 1] = inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self._lower = lower

    @cached_property
    def hash(self) -> np.ndarray:
        data = self.data
        forward, backward = _powers(_ODD, len(data) + 1)
        codes = (_BYTE_CODE[LOWER] if self._lower else _BYTE_CODE)[data]
        codes *= forward[: len(data)]
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(codes, out=total[1:])
        return mix((total[self.end] - total[self.start]) * backward[self.start] + (self.end - self.start).astype(U64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from every word on, and whether they all lie in one text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, U64), np.zeros(0, bool)
        forward, backward = _powers(_WINDOW_ODD, n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(self.hash, seed + 1) * forward[:n], out=total[1:])
        at = n - size + 1
        text = self.text_of_word()
        return mix((total[size:] - total[:at]) * backward[:at], seed), text[:at] == text[size - 1 :]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows of about `limit` bytes; null texts are empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        width = np.int32
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, until, data[offsets[row] : offsets[until]], offsets[row : until + 1] - offsets[row]
        row = until


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in runs of about a megabyte of texts in `column`, for work with Python strings."""
    for batch in batches:
        for row, until, _, _ in chunks(batch.column(column)):
            yield batch.slice(row, until - row)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span."""
    forward, backward = _powers(_ODD, len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * forward[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * backward[start] + (end - start).astype(U64))


class Sums:
    """Prefix sums of a sequence of codes, for hashes of its parts."""

    def __init__(self, codes: np.ndarray):
        forward, self.backward = _powers(_ODD, len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * forward[: len(codes)], out=self.total[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of codes[start:end]."""
        return mix((self.total[end] - self.total[start]) * self.backward[start])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` neighbours."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of consecutive values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
