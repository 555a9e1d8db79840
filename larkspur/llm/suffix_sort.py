"""External suffix sorting by induction, with common-prefix lengths.

Suffix tuples (position, length of the prefix shared with the predecessor) travel through monotone priority
queues keyed by first symbol. A queue keeps recent blocks in memory and appends older ones to a file, so its
memory is a parameter whatever the input's length. S*-substrings are sorted and named, the shorter string of
names is sorted recursively (in memory once it fits), and its order and common prefixes induce those of the
L suffixes, which induce those of the S suffixes.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

BIG = np.int32(2**30)
#: Names that are sorted in memory rather than by a further level of induction.
BASE = 1 << 22
#: Tuples taken from a queue at once.
BLOCK = 1 << 16


class BlockQueue:
    """A monotone priority queue of (position, lcp) tuples: by key, and first in first out within a key.

    Blocks beyond `memory` bytes are appended to one file and read back when their key comes up.
    """

    def __init__(self, path: str, memory: int, sign: int = 1):
        self.path, self.memory, self.sign, self.size = path, memory, sign, 0
        self.blocks: dict[int, list] = {}
        self.heap: list[int] = []
        self.file = None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if key not in self.blocks:
            self.blocks[key] = []
            heapq.heappush(self.heap, self.sign * key)
        self.blocks[key].append((pos, lcp))
        self.size += pos.nbytes + lcp.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")  # noqa: SIM115
        self.file.seek(0, os.SEEK_END)
        for blocks in self.blocks.values():
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    blocks[i] = (at, len(block[0]))
        self.size = 0

    def next_key(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def has(self, key: int) -> bool:
        return key in self.blocks

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples that wait under `key`, which is the queue's next."""
        got = []
        for block in self.blocks.pop(key):
            if not isinstance(block[0], np.ndarray):
                at, n = block
                self.file.seek(at)
                block = np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)
            else:
                self.size -= block[0].nbytes + block[1].nbytes
            got.append(block)
        heapq.heappop(self.heap)
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


class _Inducer:
    """Pushes the predecessors of scanned suffixes, with 1 + the least lcp passed since the last push under that key."""

    def __init__(self, text: np.ndarray, kinds: np.ndarray, kind: bool, queue: BlockQueue):
        self.text, self.kinds, self.kind, self.queue = text, kinds, kind, queue
        self.last: dict[int, tuple[int, int]] = {}
        self.at: list[int] = []  # batches and the least lcp of each and all later ones: a monotone stack
        self.low: list[int] = []
        self.batch = 0

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(pos), BLOCK):
            self._scan(pos[i : i + BLOCK], lcp[i : i + BLOCK])

    def _scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        idx = np.flatnonzero((pos > 0) & (self.kinds[before] == self.kind))
        if len(idx):
            keys = self.text[before[idx]]
            order = np.argsort(keys, kind="stable")
            idx, keys = idx[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(first[1:], len(idx))
            value = np.empty(len(idx), np.int32)
            lo, hi = idx[:-1] + 1, idx[1:]
            lo = np.where(keys[1:] == keys[:-1], lo, hi)  # a group's first is set below
            value[1:] = _range_min(lcp, lo, hi)
            head = np.minimum.accumulate(lcp)
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], BIG)
            targets = before[idx]
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                key = int(keys[a])
                if key in self.last:
                    since, rest = self.last[key]
                    value[a] = min(int(head[idx[a]]), rest, self._since(since))
                else:
                    value[a] = -1
                self.last[key] = self.batch, int(tail[idx[b - 1] + 1])
                self.queue.push(key, targets[a:b], value[a:b] + np.int32(1))
        low = int(lcp.min())
        while self.low and self.low[-1] >= low:
            self.low.pop()
            self.at.pop()
        self.at.append(self.batch)
        self.low.append(low)
        self.batch += 1

    def _since(self, batch: int) -> int:
        """The least lcp of the whole batches after `batch`."""
        k = bisect_left(self.at, batch + 1)
        return self.low[k] if k < len(self.low) else int(BIG)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair, both ends included."""
    if not len(lo):
        return np.empty(0, np.int32)
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(lo), np.int32)
    table, k = values, 0
    top = int(level.max())
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if k == top:
            return out
        table, k = np.minimum(table[: -(1 << k)], table[1 << k :]), k + 1


def _kinds(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (less than the next suffix)."""
    up, same = text[:-1] < text[1:], text[:-1] == text[1:]
    settled = np.flatnonzero(~same)  # a run of equal symbols has the kind of its last
    return np.append(np.repeat(up[settled], np.diff(settled, prepend=-1)), True)


def _packed(text: np.ndarray, width: int, bits: int) -> np.ndarray:
    """At each place the next `width` symbols in one number; zeros lie beyond the end."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(width, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    for i in range(width):
        out |= padded[i : i + len(text)] << np.uint64(bits * (width - 1 - i))
    return out


def _common(keys: np.ndarray, width: int, bits: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b; those of at least cap may be given as less, but not under cap."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(keys)
    while len(live):
        x, y = keys[np.minimum(a[live] + out[live], n - 1)], keys[np.minimum(b[live] + out[live], n - 1)]
        same = x == y
        diff = x[~same] ^ y[~same]
        top = np.frexp(diff.astype(np.float64))[1] - 1  # rounding may count one bit too many
        top = np.where((diff >> top.astype(np.uint64)) == 0, top - 1, top)
        out[live[~same]] += width - 1 - top // bits
        live = live[same]
        out[live] += width
        live = live[(out[live] < cap) & (np.maximum(a[live], b[live]) + out[live] < n)]
    return out


def _doubled(names: np.ndarray, start: tuple[np.ndarray, int] | None = None, levels: list | None = None) -> np.ndarray:
    """The suffix array of a string with a unique least last symbol, by prefix doubling in memory.

    start: numbers that order the suffixes by their first k symbols, and k. levels: gets (k, ranks by the
    first k symbols) for each k at which some were equal.
    """
    n = len(names)
    key, k = start or (names, 1)
    while True:
        order = np.argsort(key)
        got = key[order]
        fresh = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])]).astype(np.int32)
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int32)
        rank[order] = fresh
        if levels is not None:
            levels.append((k, rank))
        key = rank.astype(np.int64) * np.int64(n + 2)
        key[: n - k] += rank[k:] + 1
        k *= 2


def _shared(names: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes, in symbols of `names`, of suffixes that the last level's doubling told apart."""
    n, out = len(names), np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        same = rank[np.minimum(a + out, n - 1)] == rank[np.minimum(b + out, n - 1)]
        out[same] += k
    live = np.arange(len(a))
    for _ in range(levels[0][0] - 1):
        live = live[names[np.minimum(a[live] + out[live], n - 1)] == names[np.minimum(b[live] + out[live], n - 1)]]
        out[live] += 1
    return out


def _names(keys: np.ndarray, width: int, bits: int, stars: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the S*-substrings (from one S* place to the next, both included)."""
    ends = np.append(stars[1:] + 1, n)
    full = np.uint64((1 << (bits * width)) - 1)
    group = np.zeros(len(stars), np.int64)
    live, off = np.arange(len(stars)), 0
    while len(live):
        left = ends[live] - stars[live] - off
        key = keys[np.minimum(stars[live] + off, n - 1)]
        short = np.clip(width - left, 0, width).astype(np.uint64) * np.uint64(bits)
        fill = np.where(short >= bits * width, full, (np.uint64(1) << np.minimum(short, np.uint64(63))) - np.uint64(1))
        key = np.where(left <= 0, full, key | fill)  # a substring that ends here is greater than one that goes on
        order = np.lexsort((key, group[live])) if off else np.argsort(key)
        g, k = group[live][order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        first_of_group = np.concatenate([[True], g[1:] != g[:-1]])
        within = np.arange(len(g)) - np.maximum.accumulate(np.where(first_of_group, np.arange(len(g)), 0))
        # within a group, an item's new rank is the group's rank plus the number of items before its equals
        at = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        group[live[order]] = g + within[at]
        size = np.diff(np.append(np.flatnonzero(new), len(g)))
        tied = np.repeat(size > 1, size)
        more = (ends[live[order]] - stars[live[order]] - off) > width
        live = live[order][tied & more]
        off += width
        # ties in which some end and some go on were told apart by `fill`
    return group


def sorted_suffixes(text: np.ndarray, folder: str, cap: int = 1 << 30, memory: int = 64 << 20, base: int = BASE, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields the suffixes of `text` by first symbol, from the greatest symbol down; within it in order.

    text: non-negative integers, of which the last is 0 and no other is. Each yield has positions and the
    lengths of the prefixes they share with the suffix before (0 for the first of a symbol). Lengths below
    cap are exact; others are at least cap.
    """
    n = len(text)
    kinds = _kinds(text)
    stars = np.flatnonzero(kinds & ~np.concatenate([[True], kinds[:-1]]))
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 64 // bits if bits <= 32 else 1)
    keys = _packed(text, width, bits)
    if not len(stars):
        stars = np.array([n - 1])
    names = _names(keys, width, bits, stars, n)
    distinct = len(np.unique(names))
    if distinct == len(stars):
        order = np.argsort(names)
        shared = np.zeros(len(stars), np.int64)
    else:
        if len(stars) <= base:
            nb, levels = max(1, int(names.max()).bit_length()), []
            nw = max(1, 64 // nb)
            order = _doubled(names, (_packed(names, nw, nb), nw), levels)
            shared = np.concatenate([[0], _shared(names, levels, order[:-1], order[1:])]) if levels else np.concatenate([[0], _common(_packed(names, nw, nb), nw, nb, order[:-1], order[1:], cap)])
        else:
            parts = list(sorted_suffixes(names, folder, cap, memory, base, depth + 1))[::-1]
            order = np.concatenate([x[0] for x in parts])
            shared = np.concatenate([x[1] for x in parts]).astype(np.int64)
    # equal names are equal substrings; what two suffixes share goes on within the first names that differ
    begin = np.zeros(len(stars), np.int64)
    ahead = np.minimum(order + shared, len(stars) - 1)
    begin = stars[ahead] - stars[order]
    prev = np.concatenate([[order[0]], order[:-1]])
    a, b = stars[prev] + begin, stars[order] + begin
    lcps = np.minimum(begin + _common(keys, width, bits, np.minimum(a, n - 1), np.minimum(b, n - 1), cap), BIG).astype(np.int32)
    lcps[0] = 0
    places = stars[order].astype(np.int64)
    heads = text[places]
    lcps[1:][heads[1:] != heads[:-1]] = 0

    def boundary(x: int, y: int) -> int:
        return int(min(_common(keys, width, bits, np.array([x]), np.array([y]), cap)[0], BIG))

    queue = BlockQueue(os.path.join(folder, f"l{depth}"), memory)
    kept = BlockQueue(os.path.join(folder, f"k{depth}"), memory, -1)
    inducer = _Inducer(text, kinds, False, queue)
    heads_at = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    star_keys, at = heads[heads_at].tolist(), 0
    while at < len(star_keys) or queue.next_key() is not None:
        key = min(x for x in (queue.next_key(), star_keys[at] if at < len(star_keys) else None) if x is not None)
        end = None
        while queue.has(key):
            pos, lcp = queue.pop(key)
            kept.push(key, pos, lcp)
            inducer.scan(pos, lcp)
            end = int(pos[-1])
        if at < len(star_keys) and star_keys[at] == key:
            i, j = heads_at[at], heads_at[at + 1] if at + 1 < len(heads_at) else len(places)
            lcp = lcps[i:j].copy()
            lcp[0] = boundary(end, int(places[i])) if end is not None else 0
            inducer.scan(places[i:j], lcp)
            at += 1
    queue.close()

    queue = BlockQueue(os.path.join(folder, f"s{depth}"), memory, -1)
    inducer = _Inducer(text, kinds, True, queue)
    none = np.empty(0, np.int64), np.empty(0, np.int32)
    while kept.next_key() is not None or queue.next_key() is not None:
        key = max(x for x in (kept.next_key(), queue.next_key()) if x is not None)
        down = []
        while queue.has(key):
            pos, lcp = queue.pop(key)
            down.append((pos, lcp))
            inducer.scan(pos, lcp)
        s_pos, s_lcp = (np.concatenate([x[k] for x in down]) for k in (0, 1)) if down else none
        l_pos, l_lcp = kept.pop(key) if kept.has(key) else none
        meet = boundary(int(l_pos[-1]), int(s_pos[-1])) if len(l_pos) and len(s_pos) else 0
        if len(l_pos):
            inducer.scan(l_pos[::-1], np.concatenate([[meet], l_lcp[:0:-1]]).astype(np.int32))
        if len(s_pos):
            up = np.concatenate([[meet], s_lcp[:0:-1]]).astype(np.int32)
            yield np.concatenate([l_pos, s_pos[::-1]]), np.concatenate([l_lcp, up])
        elif len(l_pos):
            yield l_pos, l_lcp
    queue.close()
    kept.close()
    yield np.array([n - 1]), np.zeros(1, np.int32)
