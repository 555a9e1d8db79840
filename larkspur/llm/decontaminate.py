"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams, looked up for each
window of words in the documents; hits are verified word by word, and their words are marked.

The set is built from blocks of benchmark items of at most BLOCK_BYTES of text (a longer item is a block of its
own) and is a few arrays: sorted hashes, and for each its item and its place in one buffer of the items' words, some
four times the text. One block is broadcast at a time: a benchmark of more blocks takes more passes, each of which
adds its marks to what the last one wrote to the shared folder. So driver and workers hold one block, whatever the
benchmark's size.

Normalised words: A-Z become a-z; a word is a run of bytes 0-9, a-z and from 0x80 on (so any non-ASCII
letter). An item of fewer than `n` words, but not none, is one window. Defined results: null and empty texts
have no words; repeated items count once by id; a null item id counts as the empty string; documents equal
in all columns give equal rows; an empty table on either side gives no hits; other columns are ignored, of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._spark import documents, durable, lean, restored

WORDS, MIN_ITEMS = 8, 2
BLOCK_BYTES = 4 << 20
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
NAMES = pa.list_(pa.string())
FILTER_BITS = 22


class GramSet:
    """The n-grams of a block of items: sorted hashes, behind a bit filter, with their items and places in a word buffer."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items = [item for item, _ in items]
        hashes, owners, starts_of, ends_of, lengths, pieces, size = [], [], [], [], set(), [], 0
        for k, (_, text) in enumerate(items):
            data = X.LOWER[np.frombuffer(text, np.uint8)]
            starts, ends, _ = X.word_spans(data, np.array([0, len(data)]), X.WORD_ALNUM)
            if not len(starts):
                continue
            m = min(n, len(starts))
            lengths.add(m)
            at = np.arange(len(starts) - m + 1)
            hashes.append(X.PrefixHash(X.word_hashes(data, starts, ends)).spans(at, at + m))
            # the words by one space: where each begins and ends in the buffer
            wide = ends - starts
            begin = size + np.cumsum(wide + 1) - wide - 1
            raw = data.tobytes()
            pieces.append(b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) + b" ")
            size += len(pieces[-1])
            owners.append(np.full(len(at), k, np.int32))
            starts_of.append(begin[at])
            ends_of.append((begin + wide)[at + m - 1])
        self.lengths, self.words = sorted(lengths), b"".join(pieces)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.owner, self.start, self.end = (np.concatenate(x)[order].astype(np.int32) if x else np.empty(0, np.int32) for x in (owners, starts_of, ends_of))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of hashes that are in the set, and for each the first and end row of its grams."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        first, end = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
        hit = first < end
        return at[hit], first[hit], end[hit]

    def items_of(self, words: bytes, first: int, end: int) -> set[int]:
        """The items among rows first .. end that have these words."""
        return {int(self.owner[k]) for k in range(first, end) if self.words[self.start[k] : self.end[k]] == words}


def _marker(shared, n: int):
    """Adds a block's marks to those (ranges, items) that the rows have already."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: GramSet = shared.value
        for batch in batches:
            before, named = batch.column(3), batch.column(4)
            for i, j, data, offsets in X.chunks(batch.column(1)):
                data = X.LOWER[data]
                starts, ends, first = X.word_spans(data, offsets, X.WORD_ALNUM)
                hits: dict[int, tuple[list, set]] = {}
                if len(starts) and len(grams.hashes):
                    prefix = X.PrefixHash(X.word_hashes(data, starts, ends))
                    for m in grams.lengths:
                        at = np.arange(max(0, len(starts) - m + 1))
                        found, low, high = grams.candidates(prefix.spans(at, at + m)) if len(at) else (at, at, at)
                        docs = np.searchsorted(first, found, "right") - 1
                        for p, d, lo, hi in zip(found.tolist(), docs.tolist(), low.tolist(), high.tolist(), strict=True):
                            if p + m > first[d + 1]:
                                continue
                            words = b" ".join(data[a:b].tobytes() for a, b in zip(starts[p : p + m], ends[p : p + m], strict=True))
                            if items := grams.items_of(words, lo, hi):
                                runs, mine = hits.setdefault(d, ([], set()))
                                runs.append((p - int(first[d]), p - int(first[d]) + m))
                                mine |= items
                ranges, names = [], []
                for d in range(j - i):
                    runs, items = hits.get(d, ((), ()))
                    runs = [*runs, *((r["start"], r["end"]) for r in before[i + d].as_py() or ())]
                    ranges.append([{"start": a, "end": b} for a, b in merged(runs)])
                    names.append(sorted({*(grams.items[k] for k in items), *(named[i + d].as_py() or ())}))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first)), pa.array(ranges, RANGES), pa.array(names, NAMES), *(c.slice(i, j - i) for c in batch.columns[5:])], ["doc_id", "text", "n_words", "ranges", "items", *batch.schema.names[5:]])

    return mark


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size: consecutive ones, of which only one block is here at a time."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    if total <= BLOCK_BYTES:
        yield [(r.item, r.text.encode()) for r in items.collect()]
        return
    block, size = [], 0
    for r in items.toLocalIterator():
        text = r.text.encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item, text))
        size += len(text)
    yield block


SCHEMA = "doc_id long, text string, n_words long, ranges array<struct<start: long, end: long>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rows: bool = False) -> DataFrame:
    """doc_id, n_words, ranges (merged [start, end) runs of hit words) and items (sorted ids) of each document.

    With rows, also the text and the other columns, as documents(row=True) has them.
    """
    spark, docs = docs.sparkSession, documents(docs, id_col, text_col, row=rows)
    schema = SCHEMA + (f", row {docs.schema['row'].dataType.simpleString()}" if rows else "")
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("ranges"), F.array().cast("array<string>").alias("items")]
    found = docs.select("doc_id", "text", *none, *(["row"] if rows else []))
    last = None
    for block in _blocks(benchmark, item_col, item_text_col):
        if last is not None:  # this pass ends before the next block is broadcast
            found = durable(found, "marks")
            last.unpersist()
        last = spark.sparkContext.broadcast(GramSet(block, n))
        found = found.mapInArrow(lean(_marker(last, n)), schema)
    return found if rows else found.drop("text")


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not ranges:
                kept.append(text)
                continue
            raw = text.encode()
            data = X.LOWER[np.frombuffer(raw, np.uint8)]
            starts, ends, _ = X.word_spans(data, np.array([0, len(raw)]), X.WORD_ALNUM)
            pieces, at = [], 0
            for r in ranges:
                pieces.append(raw[at : starts[r["start"]]])
                at = ends[r["end"] - 1]
            pieces.append(raw[at:])
            kept.append(b"".join(pieces).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), *batch.columns[2:]], names=batch.schema.names)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = WORDS, min_items: int = MIN_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` without contamination: what = "documents" drops those with windows of min_items items or
    more, "spans" cuts the hit words (with what lies between them) out of every document."""
    found = find_contamination(docs, benchmark, n, id_col, text_col, item_col, item_text_col, rows=True)
    if what == "documents":
        found = found.where(F.size("items") < min_items)
    else:
        found = found.mapInArrow(lean(_remover), found.schema)
    return restored(found, docs.columns, text_col)
