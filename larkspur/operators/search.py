"""Full-text search: analyzers, an inverted index as a DataFrame, predicates, BM25, suggestions, highlights.

An index is a table of postings (doc, field, term, tf, positions, length). Predicates are small trees that
lower to (doc, score) frames; the few terms of a query are pushed to the postings' scan as an IN list, so
only their postings are read and shuffled.
"""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.stemming import LANGUAGES, STEMMERS, STOP, stem

K1, B = 1.2, 0.75
MAX_TOKEN = 255
RUN_TOKENS = 1 << 21

# Words by the Unicode segmentation rules: letters joined by ' . : between letters, digits by , . ; ' between
# digits, underscores join both; Han and Hiragana one by one, Katakana in runs.
_LETTER = r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
_ONE = rf"(?:[A-Za-z0-9_]++|{_LETTER}|\p{{Nd}}|_)[\p{{M}}\u200D]*"  # plain letters and digits go by the run
WORD = rf"(?!_+(?![\p{{L}}\p{{Nd}}_]))(?:{_ONE}(?:(?<=[\p{{L}}\p{{M}}])['’.:·](?={_LETTER})|(?<=\p{{Nd}})[.,;'](?=\p{{Nd}}))?)+|[\p{{IsHan}}\p{{IsHiragana}}]\p{{M}}*|\p{{IsKatakana}}+"


# --- analyzers ---------------------------------------------------------------------------------------------


def _fold(c: Column) -> Column:
    """Letters with marks to plain ones, by a fixed table of the Latin letters that decompose."""
    plain, marked = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii():
            marked.append(chr(code))
            plain.append(base)
    return F.translate(c, "".join(marked), "".join(plain))


def _grams(a: int, b: int, edge: bool, lower: bool = True):
    if not 1 <= a <= b <= 32:
        raise ValueError("n-grams are of 1 to 32 characters")

    def run(c: Column) -> Column:
        low = F.lower(c) if lower else c
        n = F.length(low)
        starts = F.array(F.lit(1)) if edge else F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        every = F.transform(starts, lambda s: F.transform(F.filter(F.sequence(F.lit(a), F.lit(b)), lambda k: s + k - 1 <= n), lambda k: F.substring(low, s, k)))
        return F.flatten(every)

    return run


def stages(spec: str) -> list[tuple[str, str | None]]:
    """(name, argument) of `tokenizer | filter | ...`; a bar within parentheses belongs to an argument."""
    parts, depth, now = [], 0, ""
    for ch in spec:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += ch
    out = []
    for part in [*parts, now]:
        m = re.fullmatch(r"(\w+)(?:\((.*)\))?", part.strip(), re.S)
        if not m:
            raise ValueError(f"no stage {part.strip()!r}")
        out.append((m[1].lower(), m[2]))
    if len(out) > 17:
        raise ValueError("at most 16 filters")
    return out


def _language(kind: str, arg: str | None) -> str:
    name = (arg or "english").strip().lower()
    if name not in LANGUAGES:
        raise ValueError(f"{kind} knows no language {name!r}")
    return name


@dataclass(frozen=True)
class Stem:
    """The one kind of stage that is not a Column expression."""

    language: str


def _within(limit: int) -> Callable[[Column], Column]:
    return lambda ts: F.filter(ts, lambda t: F.octet_length(t) <= limit)


def _filter(kind: str, arg: str | None) -> Callable[[Column], Column] | Stem:
    if kind == "lowercase":
        return lambda ts: F.transform(ts, F.lower)
    if kind in ("ascii_folding", "folding"):
        return lambda ts: F.transform(ts, _fold)
    if kind == "alphanum_only":
        return lambda ts: F.filter(ts, lambda t: t.rlike(r"^[\p{L}\p{N}]+\z"))
    if kind == "remove_long":
        limit = int(arg or MAX_TOKEN + 1)
        if limit < 1:
            raise ValueError("remove_long takes a length of 1 or more")
        return _within(limit - 1)
    if kind == "stop":
        words = STOP.get(_language(kind, arg), [])
        return (lambda ts: F.filter(ts, lambda t: ~t.isin(*words))) if words else lambda ts: ts
    if kind == "stopwords":
        words = [w.strip() for w in (arg or "").split(",") if w.strip()]
        if not words:
            raise ValueError("stopwords takes a word or more")
        return lambda ts: F.filter(ts, lambda t: ~t.isin(*words))
    if kind == "stem":
        return Stem(_language(kind, arg))
    raise ValueError(f"no filter {kind!r}")


def _tokenizer(kind: str, arg: str | None, alone: bool) -> Callable[[Column], Column]:
    if arg is not None and kind not in ("ngram", "edge_ngram", "regex"):
        raise ValueError(f"{kind} takes no argument")
    if kind in ("unicode", "standard"):
        return lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))
    if kind == "whitespace":
        split = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
        return (lambda c: _within(MAX_TOKEN)(split(c))) if alone else split
    if kind == "keyword":
        return lambda c: F.array(c)
    if kind in ("ngram", "edge_ngram"):
        a, b = (int(x) for x in (arg or "0,0").split(","))
        return _grams(a, b, kind == "edge_ngram", alone)
    if kind == "regex" and arg:
        re.compile(arg)
        return lambda c: F.regexp_extract_all(c, F.lit(f"({arg})"), F.lit(1))
    raise ValueError(f"no tokenizer {kind!r}")


@lru_cache(maxsize=256)
def pipeline(spec: str) -> tuple:
    """The stages of an analyzer, given by name or as a pipeline: functions of Columns, and Stem."""
    (head, arg), *rest = stages(spec)
    if not rest and arg is None and head in ("standard", "folding", *LANGUAGES):
        words = lambda c: _within(MAX_TOKEN)(_tokenizer("unicode", None, True)(F.lower(c)))
        more = [("folding", None)] if head == "folding" else [("stop", head), ("stem", head)] if head != "standard" else []
        return (words, *(_filter(k, a) for k, a in more))
    return (_tokenizer(head, arg, not rest), *(_filter(k, a) for k, a in rest))


def analyze(spec: str, c: Column) -> Column:
    """The tokens of a text, in order, by an analyzer's name or a pipeline `tokenizer | filter | ...`."""
    for step in pipeline(spec):
        c = stemmed(c, step.language) if isinstance(step, Stem) else step(c)
    return c


def analyzed(df: DataFrame, column: str, specs: dict[str, str]) -> DataFrame:
    """`df` with the tokens of a text by several language analyzers, whose words are found once a row."""
    out = df.withColumn("_words", pipeline("standard")[0](F.col(column)))
    for name, spec in specs.items():
        if spec not in LANGUAGES:
            raise ValueError(f"{spec!r} is no language")
        c = F.col("_words")
        for step in pipeline(spec)[1:]:
            c = stemmed(c, step.language) if isinstance(step, Stem) else step(c)
        out = out.withColumn(name, c)
    return out.drop("_words")


@lru_cache(maxsize=4096)
def _analyzed(spec: str, text: str) -> tuple[str, ...]:
    spark, value, steps = SparkSession.active(), text, list(pipeline(spec))
    while steps:
        if isinstance(steps[0], Stem):
            language = steps.pop(0).language
            value = [stem(t, language) for t in value]
            continue
        c = F.col("t") if isinstance(value, str) else F.from_json("t", "array<string>")
        while steps and not isinstance(steps[0], Stem):
            c = steps.pop(0)(c)
        # over a local relation the optimizer evaluates the very expressions that index the table, without a job
        rows = spark.sql("SELECT t FROM VALUES (:v) AS x(t)", args={"v": value if isinstance(value, str) else json.dumps(value)})
        value = rows.select(c.alias("t")).first()["t"] or []
    return tuple(value)


def analyze_text(spec: str, text: str) -> list[str]:
    """The same for a query's text: the stages of analyze() run on it as on a row, and the same stemmers."""
    return list(_analyzed(spec, text))


def stemmed(tokens: Column, language: str = "english") -> Column:
    if language not in STEMMERS:
        return tokens

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, str] = {}

        def one(t: str) -> str:
            got = cache.get(t)
            if got is None:
                got = cache[t] = stem(t, language)
            return got

        for lists in parts:
            if len(cache) > 200_000:
                cache.clear()
            coded = lists.flatten().dictionary_encode()  # each different token of a batch is looked up once
            stems = pa.array([one(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), stems, mask=lists.is_null())

    return run(tokens)


# --- the index ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextField:
    """How a column is indexed."""

    name: str
    analyzer: str = "standard"
    search_analyzer: str | None = None
    boost: float = 1.0
    copy_to: str | None = None
    synonyms: str = ""
    alias: str | None = None

    @property
    def label(self) -> str:
        """Its name in the index; a column may be indexed twice."""
        return self.alias or self.name

    def query_terms(self, text: str) -> list[str]:
        return analyze_text(self.search_analyzer or self.analyzer, text)

    def alternatives(self) -> dict[str, list[list[str]]]:
        """Query-time synonyms: `a, b; c, d e` make each of a group stand for all."""
        out: dict[str, list[list[str]]] = {}
        for group in filter(None, (g.strip() for g in self.synonyms.split(";"))):
            every = [self.query_terms(w) for w in group.split(",")]
            for ts in every:
                out.setdefault(" ".join(ts), []).extend(x for x in every if x != ts)
        return out


def _postings(held: list[pa.RecordBatch], labels: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents (doc, tokens), by term and then in the documents' order."""
    docs, lists = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
    lengths, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(by_name), np.empty(len(by_name), np.int32)
    rank[by_name.to_numpy()] = np.arange(len(by_name), dtype=np.int32)
    term = rank[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    at = np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    order = np.argsort(term, kind="stable")  # of a term, documents and places stay in their order
    term, doc, at = term[order], doc[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.append(starts[1:], len(term))
    for label in labels:
        for a in range(0, len(starts), 1 << 16):
            s, e = starts[a : a + (1 << 16)], ends[a : a + (1 << 16)]
            positions = pa.ListArray.from_arrays(pa.array(np.append(s, e[-1]) - s[0], pa.int32()), pa.array(at[s[0] : e[-1]]))
            parts = [pa.array([label]).take(pa.array(np.zeros(len(s), np.int32))), docs.take(pa.array(doc[s])), names.take(pa.array(term[s])), pa.array(e - s, pa.int64()), positions, pa.array(lengths[doc[s]])]
            yield pa.RecordBatch.from_arrays(parts, ["field", "doc", "term", "tf", "positions", "length"])


def _runs(labels: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of one task's documents, in sorted runs of RUN_TOKENS tokens or a little more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            sizes = pc.list_value_length(b.column(1))
            some = pc.fill_null(pc.greater(sizes, 0), False)
            if pc.any(some).as_py():
                held.append(b.filter(some))  # a condition on the tokens in the plan would have them worked out twice
                n += pc.sum(sizes).as_py()
            if n >= RUN_TOKENS:
                yield from _postings(held, labels)
                held, n = [], 0
        if held:
            yield from _postings(held, labels)

    return run


@dataclass
class Index:
    """Postings of the text fields of `docs`, whose primary key is `pk`."""

    docs: DataFrame
    pk: str
    fields: list[TextField]
    postings: DataFrame = field(init=False)
    _stats: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        parts = []
        for f in self.fields:
            tokens = self._tokens(f).where("size(tokens) > 0")
            rows = tokens.select("doc", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "term"))
            part = rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"), F.first("length").alias("length"))
            parts.append(part.select(F.lit(f.label).alias("field"), "doc", "term", "tf", "positions", "length"))
            if f.copy_to:
                parts.append(part.select(F.lit(f.copy_to).alias("field"), "doc", "term", "tf", "positions", "length"))
        self.postings = parts[0]
        for p in parts[1:]:
            self.postings = self.postings.unionAll(p)

    def _tokens(self, f: TextField) -> DataFrame:
        return self.docs.select(F.col(self.pk).alias("doc"), analyze(f.analyzer, F.col(f"`{f.name}`")).alias("tokens"))

    @staticmethod
    def _schema(docs: DataFrame, pk: str) -> str:
        return f"field string, doc {docs.schema[pk].dataType.simpleString()}, term string, tf long, positions array<int>, length int"

    def saved(self, path: str) -> Index:
        """Writes the postings with the fields' statistics beside them, and reads from there from then on.

        Each task inverts the documents that it reads and writes their postings in runs sorted by term, so nothing is shuffled
        or spilled and a frequent term is spread over all files; a query's terms prune row groups and pages by their least
        and greatest term.
        """
        spark, schema = self.docs.sparkSession, self._schema(self.docs, self.pk)
        rows = _union([self._tokens(f).mapInArrow(_runs([x for x in (f.label, f.copy_to) if x]), schema) for f in self.fields])

        def write(rows: DataFrame) -> None:
            rows.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")

        write(rows)
        kept = spark.read.schema(schema).parquet(f"{path}/postings")
        per_doc = kept.groupBy("field", "doc").agg(F.max("length").alias("n"), F.sum("tf").alias("tokens"))
        counted = per_doc.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), F.count_if(F.col("tokens") != F.col("n")).alias("repeated"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        if spark.read.schema("repeated long").parquet(f"{path}/stats").where("repeated > 0").limit(1).count():
            # a key that several rows share is one document, which only a shuffle brings together
            write(self.postings.repartition("field", "term").sortWithinPartitions("field", "term"))
            kept = spark.read.schema(schema).parquet(f"{path}/postings")
        self.postings = kept
        self._read_stats(path)
        return self

    def _read_stats(self, path: str) -> None:
        rows = self.docs.sparkSession.read.schema("field string, docs long, mean double").parquet(f"{path}/stats").collect()  # one row a field
        self._stats = {f: (0, 0.0) for x in self.fields for f in (x.label, x.copy_to) if f} | {r.field: (r.docs, r.mean) for r in rows}

    @classmethod
    def opened(cls, docs: DataFrame, pk: str, fields: list[TextField], path: str) -> Index:
        """An index that saved() wrote for these documents and fields."""
        ix = cls.__new__(cls)
        ix.docs, ix.pk, ix.fields = docs, pk, fields
        ix.postings = docs.sparkSession.read.schema(cls._schema(docs, pk)).parquet(f"{path}/postings")
        ix._read_stats(path)
        return ix

    def field(self, name: str) -> TextField:
        for f in self.fields:
            if f.label == name:
                return f
            if f.copy_to == name:
                return replace(f, name=name, alias=None, boost=1.0)
        raise ValueError(f"{name} is not in the index")

    def stats(self, name: str) -> tuple[int, float]:
        """Documents that have the field, and their mean length."""
        if name not in self._stats:
            f = self.field(name)
            source = next(x.name for x in self.fields if name in (x.label, x.copy_to))
            tokens = F.size(analyze(f.analyzer, F.col(f"`{source}`")))
            row = self.docs.select(tokens.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("c"), F.avg("n").alias("m")).first()
            self._stats[name] = row.c, row.m or 0.0
        return self._stats[name]

    def of(self, name: str) -> DataFrame:
        return self.postings.where(F.col("field") == name)


# --- predicates --------------------------------------------------------------------------------------------


def _bm25(ix: Index, name: str, rows: DataFrame, boost: float) -> DataFrame:
    """(doc, score) from postings of the query's terms; df is counted on those postings."""
    n, mean = ix.stats(name)
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    return rows.join(df, "term").select("doc", "term", (idf * tf * boost).alias("score"))


class Query:
    """A predicate over an index: score(ix) gives doc, score of the documents that match."""

    def score(self, ix: Index) -> DataFrame:
        raise NotImplementedError


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc").agg(F.sum("score").alias("score"))


@dataclass
class Match(Query):
    """Any of a text's terms; of several fields the best counts (dis-max)."""

    fields: Sequence[str]
    text: str

    def score(self, ix: Index) -> DataFrame:
        per_field = [_sum(self.terms(ix, f)) for f in self.fields or [f.label for f in ix.fields]]
        if len(per_field) == 1:
            return per_field[0]
        return _union(per_field).groupBy("doc").agg(F.max("score").alias("score"))

    def terms(self, ix: Index, name: str) -> DataFrame:
        f = ix.field(name)
        terms = f.query_terms(self.text)
        more, phrases = f.alternatives(), []
        words = list(terms)
        for size in (3, 2, 1):
            for i in range(len(terms) - size + 1):
                for other in more.get(" ".join(terms[i : i + size]), []):
                    words += other if len(other) == 1 else []
                    phrases += [other] if len(other) > 1 else []
        counts = {t: words.count(t) for t in words}
        rows = ix.of(name).where(F.col("term").isin(list(counts)))
        scored = _bm25(ix, name, rows, f.boost)
        for p in phrases:
            scored = scored.unionAll(MatchPhrase(name, " ".join(p)).score(ix).select("doc", F.lit(" ".join(p)).alias("term"), "score"))
        return scored


@dataclass
class MatchCross(Query):
    """Fields as one: of each term the best field counts, then terms add up."""

    fields: Sequence[str]
    text: str

    def score(self, ix: Index) -> DataFrame:
        every = _union([Match([f], self.text).terms(ix, f) for f in self.fields])
        return _sum(every.groupBy("doc", "term").agg(F.max("score").alias("score")))


@dataclass
class MatchPhrase(Query):
    """A text's terms in a row; with slop, terms in order with at most that many moves."""

    name: str
    text: str
    slop: int = 0

    def score(self, ix: Index) -> DataFrame:
        f = ix.field(self.name)
        terms = f.query_terms(self.text)
        if len(terms) < 2:
            return Match([self.name], self.text).score(ix)
        rows = ix.of(self.name).where(F.col("term").isin(sorted(set(terms))))
        scored = _sum(_bm25(ix, self.name, rows, f.boost))
        by = rows.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p")).where(F.size("p") == len(set(terms)))
        if self.slop == 0:
            rest = [F.try_element_at("p", F.lit(t)) for t in terms]
            hit = F.exists(rest[0], lambda s: _all([F.array_contains(r, s + k) for k, r in enumerate(rest[1:], 1)]))
            by = by.where(hit)
        else:
            by = by.where(_near(F.array(*(F.try_element_at("p", F.lit(t)) for t in terms)), self.slop))
        return scored.join(by.select("doc"), "doc", "left_semi")


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _near(positions: Column, slop: int) -> Column:
    """Whether at most slop moves put one position of each term in a row: of positions less places, some window of slop holds one of each term."""
    shifted = F.transform(positions, lambda ps, k: F.transform(ps, lambda p: p - k))
    return F.exists(F.flatten(shifted), lambda low: F.forall(shifted, lambda ps: F.exists(ps, lambda p: p.between(low, low + slop))))


@dataclass
class Terms(Query):
    """Documents with a term that a condition holds for: prefix, wildcard, regexp or fuzzy; all score 1."""

    name: str
    test: object  # Column -> Column over the term

    def score(self, ix: Index) -> DataFrame:
        return ix.of(self.name).where(self.test(F.col("term"))).select("doc").distinct().withColumn("score", F.lit(1.0))


def prefix(name: str, text: str) -> Query:
    return Terms(name, lambda t: t.startswith(text.lower()))


def wildcard(name: str, pattern: str) -> Query:
    p = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return Terms(name, lambda t: t.rlike(f"^{p}\\z"))


def regexp(name: str, pattern: str) -> Query:
    return Terms(name, lambda t: t.rlike(f"^(?:{pattern})\\z"))


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and transpositions of neighbours, each 1; beyond `most` any greater number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def byte_distance(a: str, b: str, most: int = 2) -> int:
    """The same over UTF-8 bytes, and with edits between transposed neighbours, as DuckDB's damerau_levenshtein counts."""
    x, y = a.encode(), b.encode()
    if abs(len(x) - len(y)) > most:
        return most + 1
    far = len(x) + len(y)
    d = [[far] * (len(y) + 2), *([far, i, *[0] * len(y)] for i in range(len(x) + 1))]
    d[1][1:] = range(len(y) + 1)
    seen: dict[int, int] = {}
    for i, p in enumerate(x, 1):
        match = 0
        for j, q in enumerate(y, 1):
            k, m = seen.get(q, 0), match
            match = j if p == q else match
            d[i + 1][j + 1] = min(d[i][j] + (p != q), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[p] = i
    return min(d[-1][-1], most + 1)


def _edits(word: str, most: int, distance: Callable[[str, str, int], int]):
    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}  # a term comes once for each of its documents

        def one(t: str) -> int:
            got = cache.get(t)
            if got is None:
                got = cache[t] = distance(word, t, most)
            return got

        for terms in parts:
            if len(cache) > 200_000:
                cache.clear()
            yield terms.map(one)

    return run


def fuzzy(name: str, text: str, edits: int = 1, distance: Callable[[str, str, int], int] = edit_distance) -> Query:
    if not 0 <= edits <= 2:
        raise ValueError("fuzzy takes up to 2 edits")
    word = text.lower()
    # levenshtein counts a transposition as two, so it bounds what can be near before Python looks at it
    return Terms(name, lambda t: (F.levenshtein(t, F.lit(word), 2 * edits) >= 0) & (_edits(word, edits, distance)(t) <= edits))


@dataclass
class MoreLikeThis(Query):
    """The most telling terms of a text (in two documents or more, at most 25), as a match."""

    name: str
    text: str
    most: int = 25
    min_df: int = 2

    def score(self, ix: Index) -> DataFrame:
        f = ix.field(self.name)
        terms = f.query_terms(self.text)
        n, _ = ix.stats(self.name)
        df = ix.of(self.name).where(F.col("term").isin(sorted(set(terms)))).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= self.min_df)
        weights = sorted(((terms.count(r.term) * math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)), r.term) for r in df.collect()), key=lambda x: (-x[0], x[1]))  # the query's own terms
        keep = [t for _, t in weights[: self.most]]
        return _sum(_bm25(ix, self.name, ix.of(self.name).where(F.col("term").isin(keep)), f.boost))


@dataclass
class And(Query):
    parts: Sequence[Query]

    def score(self, ix: Index) -> DataFrame:
        scores = [p.score(ix) for p in self.parts if not isinstance(p, Not)]
        if not scores:
            scores = [ix.docs.select(F.col(ix.pk).alias("doc"), F.lit(0.0).alias("score"))]
        out = _union(scores).groupBy("doc").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(scores)).drop("n")
        for p in self.parts:
            if isinstance(p, Not):
                out = out.join(p.part.score(ix).select("doc"), "doc", "left_anti")
        return out


@dataclass
class Or(Query):
    parts: Sequence[Query]

    def score(self, ix: Index) -> DataFrame:
        return _sum(_union([p.score(ix) for p in self.parts]))


@dataclass
class Not(Query):
    part: Query

    def score(self, ix: Index) -> DataFrame:
        every = ix.postings.select("doc").distinct()
        return every.join(self.part.score(ix).select("doc"), "doc", "left_anti").withColumn("score", F.lit(0.0))


@dataclass
class Boosted(Query):
    """What must match, with the scores of what may match on top."""

    need: Query
    may: Sequence[Query]

    def score(self, ix: Index) -> DataFrame:
        out = self.need.score(ix)
        more = _sum(_union([p.score(ix) for p in self.may])).withColumnRenamed("score", "more")
        return out.join(more, "doc", "left").select("doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


@dataclass
class Range(Query):
    """A range of a column's values, as a query string writes it: [a TO b] or {a TO b}."""

    name: str
    low: str | None
    high: str | None
    low_open: bool = False
    high_open: bool = False

    def score(self, ix: Index) -> DataFrame:
        c, t = F.col(self.name), ix.docs.schema[self.name].dataType
        rows = ix.docs
        if self.low not in (None, "*"):
            v = F.lit(self.low).cast(t)
            rows = rows.where(c > v if self.low_open else c >= v)
        if self.high not in (None, "*"):
            v = F.lit(self.high).cast(t)
            rows = rows.where(c < v if self.high_open else c <= v)
        return rows.where(c.isNotNull()).select(F.col(ix.pk).alias("doc"), F.lit(1.0).alias("score"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_QS = re.compile(r'\s*(?:(\()|(\))|([+-])?(?:(\w+):)?(?:"([^"]*)"|([\[{])\s*(\S+)\s+TO\s+(\S+?)\s*([\]}])|([^\s()"]+)))')


def query_string(text: str, fields: Sequence[str] = ()) -> Query:
    """term, "phrase", col:term, +must, -not, AND, OR, NOT, ( ), col:[a TO b] and prefix*; OR unless said otherwise."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _QS.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def leaf(m: re.Match) -> Query:
        cols = [m[4]] if m[4] else list(fields)
        if m[5] is not None:
            parts = [MatchPhrase(c, m[5]) for c in cols] if cols else []
            return parts[0] if len(parts) == 1 else Or(parts) if parts else Match([], m[5])
        if m[6]:
            return Range(m[4], m[7], m[8], m[6] == "{", m[9] == "}")
        word = m[10]
        if word.endswith("*") and cols:
            return Or([prefix(c, word[:-1]) for c in cols]) if len(cols) > 1 else prefix(cols[0], word[:-1])
        return Match(cols, word)

    def group() -> Query:
        nonlocal pos
        must, may, no, way = [], [], [], None
        negate = False
        while pos < len(tokens) and not tokens[pos][2]:
            m = tokens[pos]
            pos += 1
            if m[10] in ("AND", "OR", "NOT") and not m[4] and not m[3]:
                if m[10] == "NOT":
                    negate = True
                elif m[10] == "AND":
                    way = "AND"
                    if may:
                        must.append(may.pop())
                else:
                    way = "OR"
                continue
            if m[1]:
                q = group()
                pos += 1
            else:
                q = leaf(m)
            if m[3] == "-" or negate:
                no.append(Not(q))
            elif m[3] == "+" or way == "AND":
                must.append(q)
            else:
                may.append(q)
            negate, way = False, None
        if must:
            need = And([*must, *no]) if len(must) + len(no) > 1 else must[0]
            return Boosted(need, may) if may else need
        if may:
            some = may[0] if len(may) == 1 else Or(may)
            return And([some, *no]) if no else some
        return And(no)

    return group()


# --- reading ----------------------------------------------------------------------------------------------


def search(ix: Index, query: Query, k: int | None = None, where: Column | None = None, sort: tuple[str, str] | None = None) -> DataFrame:
    """The documents that match with `_score`; the k first by score (or a column), ties by primary key."""
    hits = query.score(ix).withColumnRenamed("doc", ix.pk).withColumnRenamed("score", "_score")
    rows = ix.docs.join(hits, ix.pk)
    if where is not None:
        rows = rows.where(where)
    if k is None:
        return rows
    if sort:
        c = F.col(sort[0])
        return rows.orderBy(c.asc_nulls_last() if sort[1] == "asc" else c.desc_nulls_first(), F.col(ix.pk).asc()).limit(k)
    return rows.orderBy(F.col("_score").desc(), F.col(ix.pk).asc()).limit(k)


def explain_score(ix: Index, name: str, text: str, pk_value: object) -> DataFrame:
    """What each term adds to one document's score."""
    f = ix.field(name)
    rows = _bm25(ix, name, ix.of(name).where(F.col("term").isin(f.query_terms(text))), f.boost)
    return rows.where(F.col("doc") == F.lit(pk_value)).select("term", "score").orderBy("term")


def suggest(ix: Index, name: str, text: str, limit: int = 5, distance: Callable[[str, str, int], int] = edit_distance) -> DataFrame:
    """input, suggestion, distance (at most 2) and doc_freq; nearest first, then most common, then by term."""
    terms = list(dict.fromkeys(ix.field(name).query_terms(text)))
    freq = ix.of(name).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    parts = []
    for t in terms:
        near = freq.where((F.levenshtein(F.col("term"), F.lit(t), 4) >= 0) & (F.col("term") != t)).withColumn("distance", _edits(t, 2, distance)(F.col("term"))).where("distance <= 2")
        near = near.orderBy("distance", F.col("doc_freq").desc(), "term").limit(limit)
        parts.append(near.select(F.lit(t).alias("input"), F.col("term").alias("suggestion"), "distance", "doc_freq"))
    return _union(parts)


def fragments(text: str, hits: list[tuple[str, bool]], size: int = 150, count: int = 1, pre: str = "<b>", post: str = "</b>", no_match: int = 0) -> list[str]:
    """The passages of at most `size` characters with most matches, in order of text, escaped and marked; hits: the text's words in order, and whether each matches."""
    spans, at = [], 0
    for word, hit in hits:
        at = text.index(word, at)
        if hit:
            spans.append((at, at + len(word)))
        at += len(word)
    if not spans:
        return [html.escape(text[:no_match], quote=False)] if no_match and text else []
    groups, i = [], 0
    while i < len(spans):
        j = i
        while j + 1 < len(spans) and spans[j + 1][1] - spans[i][0] <= size:
            j += 1
        groups.append((i, j))
        i = j + 1
    best = sorted(sorted(groups, key=lambda g: (g[0] - g[1], g[0]))[:count])
    out = []
    for i, j in best:
        pad = max(0, size - (spans[j][1] - spans[i][0]))
        at, end = max(0, spans[i][0] - pad // 2), min(len(text), spans[j][1] + (pad + 1) // 2)
        pieces = []
        for a, b in spans[i : j + 1]:
            pieces += [html.escape(text[at:a], quote=False), pre, html.escape(text[a:b], quote=False), post]
            at = b
        out.append("".join(pieces) + html.escape(text[at:end], quote=False))
    return out


def highlight(column: Column, terms: Sequence[str], analyzer: str = "standard", **options) -> Column:
    """HIGHLIGHT: the best passage as a string, or several as an array if `count` is above 1.

    A word matches if one of its own tokens is a term. Stages up to the first stemmer run as expressions; the
    stemmer, and nothing after it, in the function that cuts the passages.
    """
    many, have, steps = options.get("count", 1) > 1, set(terms), pipeline(analyzer)
    last = next((i for i, x in enumerate(steps) if isinstance(x, Stem)), len(steps))
    language = steps[last].language if last < len(steps) else None
    words = F.regexp_extract_all(column, F.lit(f"({WORD})"), F.lit(1))

    def tokens(w: Column) -> Column:
        for step in steps[:last]:
            w = step(w)
        return w

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, words: pd.Series, tokens: pd.Series) -> pd.Series:
        def one(text, ws, every):
            hit = [any((stem(t, language) if language else t) in have for t in ts) for ts in every]
            return fragments(text, list(zip(ws, hit, strict=True)), **options)

        return pd.Series([one(t or "", ws if ws is not None else [], ts if ts is not None else []) for t, ws, ts in zip(texts, words, tokens, strict=True)])

    out = run(column, words, F.transform(words, tokens))
    return out if many else F.coalesce(F.try_element_at(out, F.lit(1)), F.lit(""))
