"""Suffix-array dedup: bytes covered by a string of min_bytes that starts at another place too are removed.

Regions around repeated minimizers (see _anchors) are dealt to shards by content; each shard's suffixes are
sorted by external induction (see suffix_sort), and runs of suffixes that share min_bytes or more, counted
with the copies of their region, are the repeated strings.

Defined results: a null text is empty and keeps its row; a text under min_bytes keeps all bytes; rows equal
in id and text count as separate places (so such a row of min_bytes or more loses everything); rows with a
null id are treated alike; an empty table gives an empty result; other columns are ignored. Kept bytes may
end within a UTF-8 character, so `kept` is binary.
"""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import _anchors as A
from larkspur.llm import _text as X
from larkspur.llm._spark import documents, lean, restored, scratch
from larkspur.llm.suffix_sort import sorted_suffixes

MIN_BYTES = 200
GRAM = 64
SHARD_BYTES = 2 << 20
QUEUE_BYTES = 16 << 20
FOUND = "h long, b int, ckey long, runs binary"


def repeated_windows(contents: list[bytes], windows: list[int], copies: list[int], length: int, memory: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each content the [start, count] runs of its windows whose string occurs at two places or more in all."""
    sizes = np.array([len(x) for x in contents])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(starts[-1]) + 1, np.uint16)
    raw = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    text[:-1] = raw
    text[:-1] += 2
    text[starts[1:] - 1] = 1  # between contents: below each byte, so no common prefix of interest crosses it
    begins = starts[:-1]
    weight = np.array(copies)
    region = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    window = np.zeros(len(text), bool)
    window[begins] = True
    window[begins + windows] ^= True
    window = np.logical_xor.accumulate(window)  # places where a window starts
    repeated = np.zeros(len(text), bool)
    repeated[:-1] = window[:-1] & (weight[region] > 1)
    folder = scratch()
    try:
        for sa, lcp in sorted_suffixes(text, folder, length, memory):
            alike = np.flatnonzero(lcp >= length)
            if len(alike):
                member = np.zeros(len(sa), bool)
                member[alike] = member[alike - 1] = True
                at = np.flatnonzero(member)
                run = np.cumsum(lcp[at] < length)
                places = sa[at]
                ok = window[places]
                total = np.bincount(run[ok], minlength=run[-1] + 1)
                repeated[places[ok & (total[run] > 1)]] = True
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    edge = np.flatnonzero(repeated[1:] != repeated[:-1]) + 1 if not repeated[0] else np.concatenate([[0], np.flatnonzero(repeated[1:] != repeated[:-1]) + 1])
    runs = edge.reshape(-1, 2)
    owner = region[runs[:, 0]]
    runs = np.stack([runs[:, 0] - begins[owner], runs[:, 1] - runs[:, 0]], 1)
    cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
    return [runs[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _shard(length: int):
    def index(ids: list, windows: list, copies: list, _least: list, contents: list) -> Iterator[pa.RecordBatch]:
        rows = [(*i, r.astype(np.int64).tobytes()) for i, r in zip(ids, repeated_windows(contents, windows, copies, length), strict=True) if len(r)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["h", "b", "ckey", "runs"])

    return index


def covered(spans: list[dict], length: int, n: int) -> np.ndarray:
    """Sorted disjoint [start, end) of the symbols that the windows in `spans` cover."""
    runs = [np.frombuffer(x["runs"], np.int64).reshape(-1, 2) + [x["s"], 0] for x in spans]
    runs = np.concatenate(runs)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1] + length - 1, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _cutter(length: int, keep: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in X.chunks(batch.column(1), 8 << 20):
                raw, spans = data.tobytes(), batch.column(2).slice(i, j - i).to_pylist()
                kept, removed, cuts = [], [], []
                for k, s in enumerate(spans):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    if not s:
                        kept.append(raw[a:b])
                        removed.append(0)
                        cuts.append([])
                        continue
                    gone = covered(s, length, b - a)
                    at, pieces = a, []
                    for x, y in gone.tolist():
                        pieces.append(raw[at : a + x])
                        at = a + y
                    pieces.append(raw[at:b])
                    kept.append(b"".join(pieces))
                    removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                    cuts.append([{"start": x, "end": y} for x, y in gone.tolist()])
                last = pa.array(kept, pa.binary()) if keep else pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), last], ["doc_id", "n_bytes", "n_removed", "spans", "kept" if keep else "kept_sha256"])

    return cut


def _spans(docs: DataFrame, min_bytes: int, shard_bytes: int) -> DataFrame:
    """documents() with `spans`; docs: documents()."""
    regions = A.candidates(docs.select("doc_id", "text"), A.Units("bytes", min_bytes, min(GRAM, max(1, min_bytes // 2))))
    return A.spread(docs, regions, lambda some: A.sharded(some, _shard(min_bytes), FOUND, shard_bytes), 2)


def suffix_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed [start, end) byte runs) and kept (the other bytes).

    With digest, kept_sha256 (lowercase hex of `kept`) takes the place of `kept`.
    """
    found = _spans(documents(docs, id_col, text_col), min_bytes, shard_bytes)
    last = "kept_sha256 string" if digest else "kept binary"
    return found.mapInArrow(lean(_cutter(min_bytes, not digest)), f"doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, {last}")


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `docs`, all of them and with all their columns, whose texts lack the repeated bytes.

    What a cut leaves of a character that it split goes too, so texts stay valid.
    """
    found = _spans(documents(docs, id_col, text_col, row=True), min_bytes, shard_bytes)
    cut = _cutter(min_bytes, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [k.decode("utf-8", "ignore") for part in cut(iter([batch.select([0, 1, 2])])) for k in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(3)], ["text", "row"])

    return restored(found.mapInArrow(lean(run), f"text string, row {found.schema['row'].dataType.simpleString()}"), docs.columns, text_col)
