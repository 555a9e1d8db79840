"""Substring dedup: words of windows that also start in a document of smaller id are removed.

Regions around repeated minimizers (see _anchors) are dealt to shards by content. Each shard builds a
compressed FM-index over its regions and streams them through it: backward search gives matching statistics,
and where a match reaches the window's length, the least doc_id in its interval says whether an earlier
document has that window.

Words are runs of bytes other than ASCII white space, compared by 64-bit hashes. Defined results: null
and empty texts have no words; a text with fewer words than a window keeps all; rows that share a doc_id are
one document's, so none of them removes from another; a null id counts as the largest; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import _anchors as A
from larkspur.llm import _text as X
from larkspur.llm._spark import documents, lean
from larkspur.llm.fm_index import FMIndex

WINDOW = 50
GRAM = 8
SHARD_BYTES = 4 << 20
#: Regions of documents that stream through an index together.
STREAMED = 4096
FOUND = "h long, b int, ckey long, runs binary"
LAST = 2**63 - 1


def earliest(contents: list[np.ndarray], windows: list[int], least: list[int], length: int) -> list[np.ndarray]:
    """For each content the least doc_id, over all contents, that holds each of its windows."""
    index, least = FMIndex(contents, length), np.array(least, np.int64)
    of_class = index.least_of_class(least)
    out = []
    for a in range(0, len(contents), STREAMED):
        some = contents[a : a + STREAMED]
        begin = np.concatenate([[0], np.cumsum(windows[a : a + STREAMED])])
        flat = np.repeat(least[a : a + STREAMED], np.diff(begin))  # a window of one place is its own
        for query, at, size, lo in index.matches(some):
            hit = np.flatnonzero(size >= length)
            k = index.shared(lo[hit])
            hit, k = hit[k >= 0], k[k >= 0]
            flat[begin[query[hit]] + at[hit]] = of_class[k]
        out += [flat[begin[i] : begin[i + 1]] for i in range(len(some))]
    return out


def _shard(length: int):
    def index(ids: list, windows: list, _copies: list, least: list, contents: list) -> Iterator[pa.RecordBatch]:
        rows = []
        found = earliest([np.frombuffer(x, np.uint64) for x in contents], windows, least, length)
        for i, docs in zip(ids, found, strict=True):
            new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            runs = np.stack([new, np.diff(np.append(new, len(docs))), docs[new]], 1)
            rows.append((*i, runs.astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["h", "b", "ckey", "runs"])

    return index


def covered(spans: list[dict], doc: int, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that a document before `doc` has."""
    runs = np.concatenate([np.frombuffer(x["runs"], np.int64).reshape(-1, 3) + [x["s"], 0, 0] for x in spans])
    runs = runs[runs[:, 2] < doc]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1] + length - 1, -1)
    return np.cumsum(change)[:n] > 0


def _cutter(length: int, keep: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in X.chunks(batch.column(1), 8 << 20):
                raw, spans = data.tobytes(), batch.column(2).slice(i, j - i).to_pylist()
                kept, words_of, removed, cuts = [], [], [], []
                for k, s in enumerate(spans):
                    words = raw[int(offsets[k]) : int(offsets[k + 1])].split()
                    words_of.append(len(words))
                    runs = []
                    if s:
                        gone = covered(s, LAST if ids[i + k] is None else ids[i + k], length, len(words))
                        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                        for a, b in reversed(runs):
                            del words[a:b]
                    removed.append(words_of[-1] - len(words))
                    cuts.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(b" ".join(words))
                last = pa.array(kept, pa.binary()).cast(pa.string()) if keep else pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), last], ["doc_id", "n_words", "n_removed", "spans", "kept" if keep else "kept_sha256"])

    return cut


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed [start, end) runs of words) and kept (the other words, by one space).

    With digest, kept_sha256 (lowercase hex of `kept` in UTF-8) takes the place of `kept`.
    """
    units = A.Units("words", window, min(GRAM, max(1, window // 2)))
    docs = documents(docs, id_col, text_col)
    regions = A.candidates(docs, units)
    found = A.spread(docs, regions, lambda some: A.sharded(some, _shard(window), FOUND, shard_bytes), 3)
    last = "kept_sha256 string" if digest else "kept string"
    return found.mapInArrow(lean(_cutter(window, not digest)), f"doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, {last}")
