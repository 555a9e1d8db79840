"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and kept in sorted hash arrays.

Counting goes in blocks: a task counts with numpy, packs its sorted keys per target partition, and a reducer
merges the blocks of its partition, so each distinct n-gram of a task costs a few shuffled bytes. Reducers
write sorted arrays to the shared folder; workers memory-map them. A word's number is its place among all
words' sorted hashes, so a pair of words is one 64-bit key.

    p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v.) + g(v) p1(w)      p1(w) = max(a(w) - D'(a(w)), 0) / A + g' / (V + 1)

with a(w) the number of different words before w, and the three discounts of each level from its counts of
counts. Probabilities of all V known tokens and the unknown one add up to 1 in every context.

Defined results: a null text is empty; a text without words is one end token; words that training lacks are
unknown and share the uniform term; without training documents N = V = 0 and every token has probability 1
in the model (1/(V+1)); equal rows count as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._blocks import BLOCK, SCHEMA, blocks, by_hash, by_range, ensure, gathered, map_array, merged, write_array
from larkspur.llm._spark import cached, durable, lean, new_path, partitions, small_batches

END = np.uint64(0x5EED0FE4D0FE4D01)
NONE = np.uint64(2**32 - 1)  # the number of an unknown word
START = np.uint64(2**32 - 2)
MANY = 2**32 - 1
#: Bytes of text for which there is a partition: a task merges and holds the n-grams of one.
PART_BYTES = 48 << 20


# --- counting ----------------------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens, each document's words and one end, and where each begins (n+1 long)."""
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets)
    begin = first + np.arange(len(first))
    out = np.full(len(starts) + len(offsets) - 1, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(offsets) - 1), np.diff(first))] = X.word_hashes(data, starts, ends)
    return out, begin


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, _, data, offsets in X.chunks(batch.column(0)):
            yield tokens(data, offsets)


@dataclass(frozen=True)
class Model:
    """Where a model's arrays lie, and its totals."""

    path: str
    parts: int
    begins: tuple[int, ...]  # number of the first word of each partition, and of all words
    n_tokens: int
    chunk: int  # words per context array
    d2: tuple[float, ...]
    d1: tuple[float, ...]
    n_pairs: int
    rest1: float  # what the lower level leaves to the uniform term

    @property
    def n_words(self) -> int:
        return self.begins[-1]


class Reader:
    """A worker's view of the arrays."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def array(self, kind: str, p: int, dtype: type) -> np.ndarray:
        if (kind, p) not in self.maps:
            self.maps[kind, p] = map_array(f"{self.model.path}/{kind}-{p}", dtype)
        return self.maps[kind, p]

    def find(self, kind: str, keys: np.ndarray, target: Callable) -> tuple[np.ndarray, np.ndarray]:
        """For different sorted keys: the place of each within its partition's array, or -1, and the partition."""
        p = target(keys)
        place = np.full(len(keys), -1, np.int64)
        order = np.argsort(p, kind="stable")
        at = np.append(np.flatnonzero(np.diff(p[order], prepend=-1)), len(p))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = order[a:b]
            have = self.array(kind, int(p[own[0]]), np.uint64)
            if len(have):
                got = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                hit = have[got] == keys[own]
                place[own[hit]] = got[hit]
        return place, p

    def values(self, kind: str, place: np.ndarray, p: np.ndarray, dtype: type) -> np.ndarray:
        """What stands at the places found; 0 for none."""
        out = np.zeros(len(place), dtype)
        for k in np.unique(p[place >= 0]).tolist():
            own = np.flatnonzero((p == k) & (place >= 0))
            out[own] = self.array(kind, k, dtype)[place[own]]
        return out

    def times(self, place: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Counts of the pairs found."""
        c = self.values("times", place, p, np.uint32).astype(np.int64)
        for k in np.flatnonzero(c == MANY).tolist():
            at = self.array("manyat", int(p[k]), np.int64)
            c[k] = self.array("many", int(p[k]), np.int64)[np.searchsorted(at, place[k])]
        return c

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (NONE if unknown) and training counts."""
        different, inverse = np.unique(hashes, return_inverse=True)
        place, p = self.find("words", different, by_range(self.model.parts))
        number = np.where(place >= 0, place + np.array(self.model.begins)[p], int(NONE)).astype(np.uint64)
        return number[inverse], self.values("counts", place, p, np.int64)[inverse]

    def dense(self, kind: str, numbers: np.ndarray, dtype: type) -> np.ndarray:
        """Values by word number; 0 for numbers beyond all."""
        n = numbers.astype(np.int64)
        p = n // self.model.chunk
        place = np.where(n < self.model.n_words + 1, n % self.model.chunk, -1)
        return self.values(kind, place, p, dtype)


@cached("kneser_ney", 2)
def reader(model: Model) -> Reader:
    return Reader(model)


def pair_keys(numbers: np.ndarray, begin: np.ndarray, start: int) -> np.ndarray:
    before = np.concatenate([[np.uint64(start)], numbers[:-1]]) if len(numbers) else numbers
    before[begin[:-1]] = np.uint64(start)
    return (before << np.uint64(32)) | numbers


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things counted 1 to 4 times; as in Chen and Goodman, kept within [0, k]."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05 * k, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discount(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.choose(np.minimum(c, 3), [0.0, *d])


def train(docs: DataFrame, text: Column) -> Model:
    """Counts the model over all rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts, path = partitions(spark, -(-size // PART_BYTES)), new_path(spark, "kneser-ney")
    target = by_range(parts)

    def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blocks((np.unique(t, return_counts=True) for t, _ in _columns(batches)), target)

    def word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, counts in merged(batches):
            write_array(f"{path}/words-{p}", keys)
            write_array(f"{path}/counts-{p}", counts[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["p", "words", "tokens"])

    got = {r.p: r for r in gathered(texts.mapInArrow(lean(word_blocks, "kneser_ney"), BLOCK), parts).mapInArrow(lean(word_arrays, "kneser_ney"), "p int, words long, tokens long").collect()}  # one row per partition
    for p in range(parts):
        if p not in got:
            write_array(f"{path}/words-{p}", np.empty(0, np.uint64))
            write_array(f"{path}/counts-{p}", np.empty(0, np.int64))
    begins = tuple(np.concatenate([[0], np.cumsum([got[p].words if p in got else 0 for p in range(parts)])]).tolist())
    n_words = begins[-1]
    if n_words >= int(START):
        raise ValueError("more different words than 32-bit numbers")
    chunk = max(1, -(-(n_words + 1) // parts))
    draft = Model(path, parts, begins, sum(r.tokens for r in got.values()), chunk, (0,) * 3, (0,) * 3, 0, 1.0)
    spread = by_hash(parts)
    start = n_words  # the number of what stands before a first word

    def pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts_of() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for t, begin in _columns(batches):
                yield np.unique(pair_keys(reader(draft).words(t)[0], begin, start), return_counts=True)

        return blocks(parts_of(), spread)

    def by_number(keys: np.ndarray) -> np.ndarray:
        return (keys // np.uint64(chunk)).astype(np.int32)

    def pair_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the pairs; passes on, per word number, what it adds up to as context and as word."""
        for p, keys, counts in merged(batches):
            c = counts[:, 0]
            write_array(f"{path}/pairs-{p}", keys)
            write_array(f"{path}/times-{p}", np.minimum(c, MANY).astype(np.uint32))
            more = np.flatnonzero(c >= MANY)  # counts of more than 32 bits stand apart, by place
            write_array(f"{path}/manyat-{p}", more)
            write_array(f"{path}/many-{p}", c[more])
            zero = np.zeros(len(keys), np.int64)
            as_context = np.stack([c, c == 1, c == 2, c >= 3, zero], 1).astype(np.int64)
            as_word = np.stack([zero, zero, zero, zero, zero + 1], 1)
            numbers = np.concatenate([keys >> np.uint64(32), keys & np.uint64(2**32 - 1)])
            totals = np.array([[(c == k).sum() for k in (1, 2, 3, 4)] + [len(keys)]])
            for block in blocks(iter([(numbers, np.concatenate([as_context, as_word]))]), by_number):
                yield block
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([totals.astype(np.int64).tobytes()], pa.binary())], schema=SCHEMA)

    middle = durable(gathered(texts.mapInArrow(lean(pair_blocks, "kneser_ney"), BLOCK), parts).mapInArrow(lean(pair_arrays, "kneser_ney"), BLOCK), "contexts")
    totals = np.sum([np.frombuffer(r.counts, np.int64) for r in middle.where("p = -1").collect()] or [np.zeros(5, np.int64)], 0)  # one row per partition
    d2 = discounts(totals[:4])

    def context_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, counts in merged(batches):
            at, size = (keys - np.uint64(p * chunk)).astype(np.int64), min(chunk, n_words + 1 - p * chunk)
            table = np.zeros((size, 5), np.int64)
            table[at] = counts
            mass = table[:, 1] * d2[0] + table[:, 2] * d2[1] + table[:, 3] * d2[2]
            write_array(f"{path}/total-{p}", table[:, 0])
            write_array(f"{path}/rest-{p}", mass / np.maximum(table[:, 0], 1))
            write_array(f"{path}/before-{p}", table[:, 4])
            a = table[:, 4]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([int((a == k).sum())]) for k in (1, 2, 3, 4)), pa.array([int((a >= 3).sum())])], ["p", "n1", "n2", "n3", "n4", "more"])

    rows = gathered(middle.where("p >= 0"), parts).mapInArrow(lean(context_arrays, "kneser_ney"), "p int, n1 long, n2 long, n3 long, n4 long, more long").collect()
    n = [sum(r[k] for r in rows) for k in ("n1", "n2", "n3", "n4", "more")]
    d1, pairs = discounts(np.array(n[:4])), int(totals[4])
    rest1 = (d1[0] * n[0] + d1[1] * n[1] + d1[2] * n[4]) / pairs if pairs else 1.0
    have = {r["p"] for r in rows}
    for p in range(-(-(n_words + 1) // chunk)):
        if p not in have:
            size = min(chunk, n_words + 1 - p * chunk)
            for kind, dtype in (("total", np.int64), ("rest", np.float64), ("before", np.int64)):
                write_array(f"{path}/{kind}-{p}", np.zeros(size, dtype))
    for p in range(parts):
        ensure(f"{path}/pairs-{p}", np.uint64)
        ensure(f"{path}/times-{p}", np.uint32)
        ensure(f"{path}/manyat-{p}", np.int64)
        ensure(f"{path}/many-{p}", np.int64)
    return Model(path, parts, begins, draft.n_tokens, chunk, d2, d1, pairs, rest1)


# --- scoring ----------------------------------------------------------------------------------------------


def log10_probabilities(r: Reader, hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each token in its document, and the tokens' training counts."""
    m = r.model
    numbers, counts = r.words(hashes)
    keys, inverse = np.unique(pair_keys(numbers, begin, m.n_words), return_inverse=True)
    v, w = keys >> np.uint64(32), keys & np.uint64(2**32 - 1)
    before = r.dense("before", w, np.int64)
    p = m.rest1 / (m.n_words + 1) + (np.maximum(before - discount(before, m.d1), 0) / m.n_pairs if m.n_pairs else 0.0)
    total = r.dense("total", v, np.int64)
    place, part = r.find("pairs", keys, by_hash(m.parts))
    c = r.times(place, part)
    rest = np.where(total > 0, r.dense("rest", v, np.float64), 1.0)
    p = np.maximum(c - discount(c, m.d2), 0) / np.maximum(total, 1) + rest * p
    return np.log10(p)[inverse], counts


def score(docs: DataFrame, model: Model, payload: Column, text: Column) -> DataFrame:
    """row (the payload), n_tokens, n_known, base_score (add-one unigrams) and score (log10 of the model's probability)."""
    small_batches(docs.sparkSession)
    rows = docs.select(payload.alias("row"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = float(model.n_tokens + model.n_words + 1)
        for batch in batches:
            for i, j, data, offsets in X.chunks(batch.column(1)):
                hashes, begin = tokens(data, offsets)
                p, c = log10_probabilities(reader(model), hashes, begin)
                doc = np.repeat(np.arange(j - i), np.diff(begin))
                total = lambda x, doc=doc, n=j - i: np.bincount(doc, x, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(begin)), pa.array(total(c > 0).astype(np.int64)), pa.array(total(np.log10((c + 1) / base))), pa.array(total(p))], ["row", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(lean(run, "kneser_ney"), f"row {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
