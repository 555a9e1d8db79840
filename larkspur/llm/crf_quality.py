"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's score comes from its own features and its neighbours', and from the label of the line before. Forward-backward gives
each line's marginal probability of being good; the mean of these, weighted by the lines' lengths, is the
document's quality.

Learning takes at most `max_train` labelled documents, those first by a hash of the id; all their lines carry
the document's label, and the likelihood of that sequence is maximised per line. Only line features of these
documents go to the driver. Scoring covers every document and every line.

Defined results: a null text is empty, and an empty text is one empty line; label rows with a null id or label
are ignored, and several labels of one document count as their majority (a tie as good); with labels of
only one kind, or none, every score is the share of good labels (1 without any); equal rows are separate; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._spark import lean, small_batches

MAX_TRAIN = 3000
#: Bytes of text after which no further document is taken: the driver holds 58 numbers for each of their lines.
MAX_BYTES = 24 << 20
CUT = 0.3

#: byte classes: other, lower, upper, digit, space, sentence marks, quotes and dashes, symbols, rules, beyond ASCII, control
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:?", "'\"()-", "#$%&*@^~+=<>{}[]\\/_`", "|", "!"), 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 10
N_CLASSES = 11
OWN = N_CLASSES + 8
N_FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and per document the number of its first line (n+1 long)."""
    n, size = len(offsets) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, offsets[owner + 1], np.append(starts[1:], size + 1) - 1)
    length = ends - starts
    m = len(starts)
    # bytes of line breaks fall to no line; empty lines of empty documents have no bytes
    line = np.repeat(np.arange(m), length)
    body = np.ones(size, bool)
    body[breaks] = False
    counts = np.bincount(line * N_CLASSES + _CLASS[data[body]], minlength=m * N_CLASSES).reshape(m, N_CLASSES)
    own = np.zeros((m, OWN))
    own[:, :N_CLASSES] = counts / np.maximum(length, 1)[:, None]
    w_start, w_end, _ = X.word_spans(data, offsets)
    of = np.searchsorted(starts, w_start, "right") - 1
    of = np.minimum(of, m - 1)
    words = np.bincount(of, minlength=m)
    hashes = X.word_hashes(data, w_start, w_end)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])]) if len(of) else np.empty(0, bool)
    some = np.maximum(words, 1)
    spans = X.PrefixHash(X.byte_symbols(data)).spans(starts, ends)
    _, inverse, times = np.unique(np.stack([owner.astype(np.uint64), spans], 1), axis=0, return_inverse=True, return_counts=True)
    own[:, N_CLASSES] = np.log1p(length) / 8
    own[:, N_CLASSES + 1] = np.bincount(of, w_end - w_start, m) / some / 10
    own[:, N_CLASSES + 2] = np.bincount(of, (w_end - w_start) <= 3, m) / some
    own[:, N_CLASSES + 3] = np.bincount(of, again, m) / some
    own[:, N_CLASSES + 4] = (times[inverse.ravel()] > 1) & (length > 0)
    own[:, N_CLASSES + 5] = length == 0
    if size:
        at = np.minimum(np.maximum(ends - 1, 0), size - 1)
        own[:, N_CLASSES + 6] = (_CLASS[data[at]] == 5) & (length > 0)
        own[:, N_CLASSES + 7] = (_CLASS[data[np.minimum(starts, size - 1)]] == 2) & (length > 0)
    out = np.zeros((m, N_FEATURES))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[first[:-1], OWN : 2 * OWN] = own[first[:-1]]  # no neighbour: the line itself
    out[last, 2 * OWN : 3 * OWN] = own[last]
    out[:, -1] = 1
    return out, length, first


@dataclass
class Crf:
    weights: np.ndarray  # log odds of good from a line's features
    same: float  # what two neighbouring lines of one label add
    prior: float | None = None  # a fixed score, where nothing was learned

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of every line, by forward-backward over all documents at once; emit: log odds per line."""
        return _marginals(emit, first, self.same)[0]


def _marginals(emit: np.ndarray, first: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good, and for each line but a document's first the probability that it has its predecessor's label.

    Messages are log odds, so one number per line and direction is enough for two labels.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]

    def through(odds: np.ndarray) -> np.ndarray:  # over one edge
        return np.logaddexp(odds + same, 0) - np.logaddexp(odds, same)

    n = len(emit)
    ahead, back = np.zeros(n), np.zeros(n)
    for t in range(1, int(sizes.max()) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, "left"))
        at = begin[:m] + t
        ahead[at] = through(ahead[at - 1] + emit[at - 1])
        at = begin[:m] + sizes[:m] - 1 - t
        back[at] = through(back[at + 1] + emit[at + 1])
    marginal = 1 / (1 + np.exp(-np.clip(ahead + emit + back, -500, 500)))
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    left, right = ahead[at - 1] + emit[at - 1], emit[at] + back[at]
    stay = np.logaddexp(left + right, 0) + same
    move = np.logaddexp(left, right)
    pair = np.zeros(n)
    pair[at] = 1 / (1 + np.exp(np.clip(move - stay, -500, 500)))
    return marginal, pair


def fit(features: np.ndarray, length: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam; each document weighs 1, shared among its lines by length."""
    if good.min(initial=1) == good.max(initial=0) or not len(good):
        return Crf(np.zeros(N_FEATURES), 0.0, float(good.mean()) if len(good) else 1.0)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weight = (length + 1) / np.bincount(doc, length + 1)[doc] / len(good)
    y = good[doc].astype(float)
    inner = np.ones(len(doc), bool)
    inner[first[:-1]] = False
    w = np.zeros(N_FEATURES + 1)
    m = v = np.zeros(N_FEATURES + 1)
    for t in range(1, steps + 1):
        p, pair = _marginals(features @ w[:-1], first, w[-1])
        g = np.append(features.T @ ((y - p) * weight), ((1 - pair) * weight)[inner].sum())
        g -= l2 * w
        g[-1] -= 0.05 * w[-1]  # all lines of a document share a label here, which overstates how labels stick
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Crf(w[:-1], float(w[-1]))


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in X.chunks(batch.column(1)):
            features, length, first = line_features(data, offsets)
            rows = [(features[a:b].astype(np.float32).tobytes(), length[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["good", "features", "length"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Crf:
    """The field learned from `labels` (id, 0 or 1) of at most max_train different documents.

    They come in order of a hash of their ids; none is taken once those before it have max_bytes of text.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    marks = marks.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("good"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(marks), "doc_id").withColumn("text_id", F.xxhash64("text"))  # at most max_train marks
    # whole documents, as many as fit
    first = rows.select("doc_id", "text_id", F.octet_length("text").alias("size")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text_id").limit(max_train)
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id", "text_id")  # over at most max_train rows
    kept = first.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") < max_bytes).select("doc_id", "text_id")
    got = rows.join(F.broadcast(kept), ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"]).select("good", "text").mapInArrow(lean(_measurer), "good int, features binary, length binary").collect()
    if not got:
        return Crf(np.zeros(N_FEATURES), 0.0, 1.0)
    # in a fixed order, so that sums of floats are the same in each run
    got.sort(key=lambda r: (bytes(r.length), bytes(r.features), r.good))
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES) for r in got]).astype(float)
    length = np.concatenate([np.frombuffer(r.length, np.int64) for r in got])
    first = np.concatenate([[0], np.cumsum([len(r.length) // 8 for r in got])])
    return fit(features, length, first, np.array([r.good for r in got]))


def score_documents(features: np.ndarray, length: np.ndarray, first: np.ndarray, crf: Crf) -> np.ndarray:
    if crf.prior is not None:
        return np.full(len(first) - 1, crf.prior)
    p = crf.marginals(features @ crf.weights, first)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.clip(np.bincount(doc, p * (length + 1), len(first) - 1) / np.bincount(doc, length + 1.0, len(first) - 1), 0, 1)


def _scorer(crf: Crf, lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in X.chunks(batch.column(1)):
                features, length, first = line_features(data, offsets)
                columns = [batch.column(0).slice(i, j - i), pa.array(score_documents(features, length, first, crf))]
                if lines:
                    p = crf.marginals(features @ crf.weights, first) if crf.prior is None else np.full(len(length), crf.prior)
                    columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(p)))
                yield pa.RecordBatch.from_arrays(columns, ["row", "score", "lines"][: len(columns)])

    return run


def score(docs: DataFrame, crf: Crf, payload: Column, text: Column, lines: bool = False) -> DataFrame:
    """row (the payload) and score of each row; with lines, also the probability of good for each line."""
    small_batches(docs.sparkSession)
    rows = docs.select(payload.alias("row"), text.cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(_scorer(crf, lines)), f"row {kind}, score double" + ", lines array<double>" * lines)
