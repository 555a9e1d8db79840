"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +-1. A letter n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a document bundles (adds) the vectors of its n-grams, and a language
prototype bundles its documents' unit vectors. What all prototypes share is taken out of them, and a document is
compared with each by cosine.

Counting n-grams first makes bundling a matrix product, so the work per document follows its different
n-grams. Prototypes are summed on the executors, one row per language and component.

Letters are Unicode letters in lower case; all else is a word boundary, which counts as a letter of its own.
Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first language
by code point; without training rows everything is `und`; equal rows are separate; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._spark import cached, lean, small_batches

DIM, GRAM, SEED = 512, 3, 20240607
#: Letters beyond a-z share this many classes, by code point.
CLASSES = 64
UND = "und"
#: Of 60 letters and more, 99.9 of 100 texts in learned languages lie above 0.3, random letters and other alphabets below 0.18.
LEAST, LETTERS = 0.2, 60


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return out


class Profiles:
    """Lazily made vectors of letter n-grams."""

    def __init__(self, dim: int, n: int, seed: int):
        self.n = n
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))
        self.rows = np.full(CLASSES**n, -1, np.int32)
        self.vectors, self.used = np.empty((0, dim), np.int8), 0

    def index(self, grams: np.ndarray) -> np.ndarray:
        """Rows of `vectors` for different n-gram numbers."""
        new = grams[self.rows[grams] < 0]
        if len(new):
            if self.used + len(new) > len(self.vectors):
                more = np.empty((max(4096, len(self.vectors), len(new)), self.letters.shape[1]), np.int8)
                self.vectors = np.concatenate([self.vectors, more])
            made = np.ones((len(new), self.letters.shape[1]), np.int8)
            for place in range(self.n):
                letter = (new // CLASSES ** (self.n - 1 - place)) % CLASSES
                made *= np.roll(self.letters, place, axis=1)[letter]
            self.rows[new] = np.arange(self.used, self.used + len(new))
            self.vectors[self.used : self.used + len(new)] = made
            self.used += len(new)
        return self.rows[grams]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vectors of the texts, and whether each has a letter."""
        n_docs = len(offsets) - 1
        raw = data.tobytes()
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(p) for p in parts])
        points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[points].astype(np.int64)
        keep = (kind > 0) | np.concatenate([[True], kind[:-1] > 0])  # runs of other characters are one boundary
        owner = np.repeat(np.arange(n_docs), sizes + 1)
        owner = np.concatenate([[0], owner])[: len(points)]
        kind, owner = kind[keep], owner[keep]
        has = np.zeros(n_docs, bool)
        has[owner[kind > 0]] = True
        out = np.zeros((n_docs, self.letters.shape[1]), np.float32)
        if len(kind) < self.n:
            return out, has
        gram = np.zeros(len(kind) - self.n + 1, np.int64)
        for place in range(self.n):
            gram = gram * CLASSES + kind[place : len(kind) - self.n + 1 + place]
        middle = owner[1 : len(gram) + 1] if self.n > 1 else owner[: len(gram)]
        within = kind[self.n // 2 : len(gram) + self.n // 2] > 0  # n-grams about a letter never cross documents
        keys, counts = np.unique(middle[within] * np.int64(CLASSES**self.n) + gram[within], return_counts=True)
        grams, column = np.unique(keys % CLASSES**self.n, return_inverse=True)
        vectors = self.vectors_of(grams)
        doc = keys // CLASSES**self.n
        for a in range(0, n_docs, 256):
            i, j = np.searchsorted(doc, [a, a + 256])
            used, place = np.unique(column[i:j], return_inverse=True)
            dense = np.zeros((min(256, n_docs - a), len(used)), np.float32)
            dense[doc[i:j] - a, place] = np.sqrt(counts[i:j])
            out[a : a + 256] = dense @ vectors[used]
        return out, has

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        at = self.index(grams)  # may replace self.vectors
        return self.vectors[at].astype(np.float32)


@cached("language_id", 2)
def _profiles(dim: int, n: int, seed: int) -> Profiles:
    return Profiles(dim, n, seed)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _bundler(dim: int, n: int, seed: int):
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, data, offsets in X.chunks(batch.column(1)):
                vectors, _ = _profiles(dim, n, seed).documents(data, offsets)
                vectors = _unit(vectors)
                for lang in set(langs[i:j]):
                    # whole numbers add up to the same sum in any order
                    got = np.rint(vectors[langs[i:j] == lang] * 2**20).astype(np.int64).sum(0)
                    sums[lang] = sums.get(lang, 0) + got
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], ["lang", "at", "total"])

    return bundle


def learn(docs: DataFrame, text: Column, lang: Column, dim: int = DIM, n: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their prototypes (unit rows, less what all share), from rows with a lang."""
    langs, protos = learn_whole(docs, text, lang, dim, n, seed)
    return langs, apart(protos)


def apart(protos: np.ndarray) -> np.ndarray:
    """Prototypes less what all share."""
    return _unit(protos - protos.mean(0)) if len(protos) > 1 else protos


def learn_whole(docs: DataFrame, text: Column, lang: Column, dim: int = DIM, n: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """The same with what all share left in the prototypes."""
    small_batches(docs.sparkSession)
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.mapInArrow(lean(_bundler(dim, n, seed), "language_id"), "lang string, at int, total long").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    by: dict[str, np.ndarray] = {}
    for r in got.collect():  # languages x dim numbers
        by.setdefault(r.lang, np.zeros(dim))[r.at] = r.total
    langs = sorted(by, key=lambda x: x.encode())
    if not langs:
        return [], np.zeros((0, dim))
    return langs, _unit(np.stack([by[x] for x in langs]))


def _predictor(langs: list[str], protos: np.ndarray, dim: int, n: int, seed: int, whole: np.ndarray | None = None):
    table = protos.T.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in X.chunks(batch.column(1)):
                vectors, has = _profiles(dim, n, seed).documents(data, offsets)
                near = np.zeros(j - i)
                if langs:
                    vectors = _unit(vectors)
                    cosine = vectors @ table
                    if whole is not None:
                        near = (vectors @ whole.T.astype(np.float32)).max(1).astype(np.float64)
                    best = cosine.argmax(1)
                    score = np.where(has, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
                    names = [langs[b] if h else UND for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                else:
                    names, score = [UND] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score.astype(np.float64)), *([] if whole is None else [pa.array(near)])], ["row", "lang_pred", "score", *([] if whole is None else ["near"])])

    return predict


def identify(docs: DataFrame, payload: Column, text: Column, langs: list[str], protos: np.ndarray, dim: int = DIM, n: int = GRAM, seed: int = SEED, whole: np.ndarray | None = None) -> DataFrame:
    """row (the payload), lang_pred and score (cosine with the prototype, from 0 for -1 to 1) of each row; with whole
    prototypes, also near, the greatest cosine with one of these."""
    small_batches(docs.sparkSession)
    rows = docs.select(payload.alias("row"), text.cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lean(_predictor(langs, protos, dim, n, seed, whole), "language_id"), f"row {kind}, lang_pred string, score double" + ", near double" * (whole is not None))


def keep_known(docs: DataFrame, least: float = LEAST, letters: int = LETTERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that are in one of the languages, whose prototypes are learned from the rows with a language.

    What is `und` goes, and so does a text of `letters` letters or more whose cosine with every whole prototype is under
    `least`, as in a language or alphabet that no row teaches, or of random letters. Shorter texts have too few
    n-grams to tell and stay.
    """
    text = F.col(f"`{text_col}`")
    langs, whole = learn_whole(docs, text, F.col(f"`{lang_col}`"))
    found = identify(docs, F.struct("*"), text, langs, apart(whole), whole=whole)
    short = F.regexp_count(F.col(f"row.`{text_col}`").cast("string"), F.lit(r"\p{L}")) < letters
    found = found.where((F.col("lang_pred") != UND) & ((F.col("near") >= least) | short))
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
