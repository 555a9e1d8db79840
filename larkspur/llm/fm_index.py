"""A compressed FM-index over integer symbols: a wavelet matrix of bit-packed levels with block ranks.

The suffix array is there only while the index is built. What stays is, for each symbol, as many bits as the shard's
alphabet needs, one byte for the common prefix with the suffix before (up to the threshold), and a bit that starts a
class of suffixes that share `threshold` symbols; with block ranks about half of the symbols at 8 bytes.

Queries run in lock step, one backward step for all at a time. Matching statistics are kept up to a threshold:
once a match is longer, its interval is cut back to that of its first `threshold` symbols.
"""

from __future__ import annotations

import numpy as np

from larkspur.llm.suffix_sort import _common, _doubled, _packed

U64 = np.uint64


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each word."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = flags
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32 if n < 2**31 else np.int64)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) set bit."""
        w = np.searchsorted(self.before, k, "right") - 1
        bits = np.unpackbits(np.ascontiguousarray(self.words[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return 64 * w + (np.cumsum(bits, 1) > (k - self.before[w])[:, None]).argmax(1)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            flags = (symbols >> level) & 1 == 1
            self.levels.append(Bits(flags))
            self.zeros.append(len(flags) - int(flags.sum()))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before at[i], plus the place where the last level keeps that symbol's first."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = level.rank1(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + one, at - one)
        return at


class FMIndex:
    """Index of several sequences of 64-bit symbols; matches never cross from one to the next."""

    def __init__(self, sequences: list[np.ndarray], threshold: int):
        sizes = np.array([len(x) for x in sequences], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n = int((sizes + 1).sum()) + 1
        self.threshold = threshold
        self.alphabet, ids = np.unique(np.concatenate(sequences) if sequences else np.empty(0, U64), return_inverse=True)
        text = np.ones(n, np.int64)
        text[-1] = 0
        inside = np.ones(n, bool)
        inside[self.begins + sizes] = False
        inside[-1] = False
        text[inside] = ids + 2
        sa = _doubled(text)
        top = max(1, int(text.max()).bit_length())
        width = 64 // top
        keys = _packed(text, width, top)
        lcp = np.concatenate([[0], _common(keys, width, top, sa[:-1], sa[1:], threshold)])
        lcp = np.minimum(lcp, threshold)
        #: common prefixes, and 0 behind the last suffix
        self.lcp = np.append(lcp, 0).astype(np.uint8 if threshold < 256 else np.int32)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 2))])
        self.wavelet = WaveletMatrix(text[sa - 1], top)
        self.base = self.wavelet.rank(np.arange(len(self.alphabet) + 2), np.zeros(len(self.alphabet) + 2, np.int64))
        #: suffixes that share `threshold` symbols form a class; one behind the last ends it
        self.edges = Bits(np.append(lcp < threshold, True))
        self.n = n
        self._places = sa

    def least_of_class(self, values: np.ndarray) -> np.ndarray:
        """The least, in each class of several suffixes, of what `values` has for the sequences they start in. Called
        once after building: the suffix array goes then. shared(): which classes these are."""
        owner = np.maximum(np.searchsorted(self.begins, self._places, "right") - 1, 0)
        del self._places
        starts = np.flatnonzero(self.lcp[:-1] < self.threshold)
        several = np.diff(np.append(starts, self.n)) > 1
        self.several = Bits(several)
        return np.minimum.reduceat(values[owner], starts)[several]

    def shared(self, lo: np.ndarray) -> np.ndarray:
        """For a place in a class's interval, the class's number among those of several suffixes, or -1."""
        c = self.edges.rank1(lo + 1) - 1
        k = self.several.rank1(c)
        return np.where(self.several.rank1(c + 1) > k, k, -1)

    @property
    def nbytes(self) -> int:
        """Bytes of all that queries need."""
        levels = [*self.wavelet.levels, self.edges, *([self.several] if hasattr(self, "several") else [])]
        return sum(x.nbytes for x in levels) + sum(x.nbytes for x in (self.lcp, self.alphabet, self.counts, self.base, self.begins))

    def encode(self, symbols: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, symbols), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == symbols, at + 2, -1) if len(self.alphabet) else np.full(len(symbols), -1)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + match, from those of the matches."""
        known = np.maximum(symbol, 0)
        start = self.counts[known] - self.base[known]
        a, b = start + self.wavelet.rank(known, lo), start + self.wavelet.rank(known, hi)
        return np.where(symbol < 0, 0, a), np.where(symbol < 0, 0, b)

    def parent(self, lo: int, hi: int) -> tuple[int, int, int]:
        """The interval and length of the longest proper prefix of a match that occurs elsewhere too."""
        size = int(max(self.lcp[lo], self.lcp[hi]))
        if size == 0:
            return 0, self.n, 0
        while self.lcp[lo] >= size:
            lo -= 1
        while self.lcp[hi] >= size:
            hi += 1
        return lo, hi, size

    def matches(self, queries: list[np.ndarray]):
        """Backward search over all queries at once.

        Yields (query numbers, positions, lengths, lo): how long a prefix of the query's rest from each
        position occurs, up to the threshold, and one suffix-array place in its interval.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = self.encode(np.concatenate(queries)) if len(queries) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)[order]
        sizes = sizes[order]
        lo, hi, size = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for t in range(int(sizes.max()) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -t, "left"))  # those longer than t
            lo, hi, size = lo[:m], hi[:m], size[:m]
            symbol = flat[ends[:m] - 1 - t]
            a, b = self.extend(symbol, lo, hi)
            for q in np.flatnonzero(a >= b).tolist():
                x, y, z = int(lo[q]), int(hi[q]), int(size[q])
                while z > 0 and symbol[q] >= 0:
                    x, y, z = self.parent(x, y)
                    u, v = self.extend(symbol[q : q + 1], np.array([x]), np.array([y]))
                    if u[0] < v[0]:
                        a[q], b[q], size[q] = u[0], v[0], z
                        break
                else:
                    a[q], b[q], size[q] = 0, self.n, -1
            lo, hi, size = a, b, size + 1
            over = np.flatnonzero(size > self.threshold)
            if len(over):
                c = self.edges.rank1(lo[over] + 1) - 1
                lo[over], hi[over], size[over] = self.edges.select1(c), self.edges.select1(c + 1), self.threshold
            yield order[:m], sizes[:m] - 1 - t, size, lo
