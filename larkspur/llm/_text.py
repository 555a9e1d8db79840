"""Vectorised text primitives on Arrow buffers: word spans, word hashes, window hashes, minimizers.

A text column arrives as one UTF-8 byte buffer with document offsets, so a whole chunk of documents is
tokenised and hashed with a few numpy passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, base & (2**64 - 1), U64)]))
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits of a polynomial hash are both usable."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class PrefixHash:
    """Hashes of any spans of a sequence of 64-bit symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * powers(len(symbols)), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inv = powers(len(self.sums), _BASE_INV)
        raw = (self.sums[ends] - self.sums[starts]) * inv[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(n, _BASE_INV)) if n > 0 else np.empty(0, U64)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_codes()[data]


WORD_SPACE = np.ones(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
WORD_ALNUM = np.zeros(256, bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x61:0x7B] = WORD_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in all documents, and per document the index of its first word (n+1 long)."""
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    here = np.append(inside, False)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return PrefixHash(byte_symbols(data)).spans(starts, ends)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n+1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if column.type in (pa.binary(), pa.large_binary()) else pa.large_string()).fill_null("" if column.type not in (pa.binary(), pa.large_binary()) else b"")
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def minimizers(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of `length` symbols that lie within one document.

    Each window is given to the k-gram of least hash in it (the leftmost of equals), so equal windows have
    anchors of equal hash at equal places. Returns for each run of windows with one anchor: document,
    first window start (within the whole array), number of windows, anchor's distance from the first start,
    anchor's hash. bounds: n_docs+1 symbol offsets.
    """
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    n = len(symbols)
    if n < length or not (np.diff(bounds) >= length).any():
        return empty
    w, bits = length - k + 1, max(1, int(n - k + 1).bit_length())
    grams = PrefixHash(symbols).windows(k)
    packed = (grams & ~U64((1 << bits) - 1)) | np.arange(len(grams), dtype=U64)
    low, span = packed, 1
    while span * 2 <= w:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    where = (low & U64((1 << bits) - 1)).astype(np.int64)
    p = np.arange(len(where))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(where)]
    valid = p + length <= bounds[doc + 1]
    p, where, doc = p[valid], where[valid], doc[valid]
    if not len(p):
        return empty
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(new, len(p)))
    return doc[new], p[new], count, where[new] - p[new], grams[where[new]]
