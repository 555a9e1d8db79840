"""Document fingerprints by randomised edit embedding.

A pointer walks over a text; at every step the character under it is written out, and a random bit shared by
all texts, chosen by step and character, says whether the pointer moves on. Texts at a small edit distance
so become long strings at a small Hamming distance: after an edit, two walks soon meet again with high
probability. The time at which a walk leaves a character is one look-up, so a text costs a look-up per
character, and all texts of a batch walk in lock step.

A fingerprint samples steps of the embedding: step t is in the sample of level l if its hash has l low zero
bits, and a document takes the level at which it has at least SAMPLES steps (level 0 has all). Samples of
neighbouring levels nest, so texts of unlike length are compared at the coarser level. A sample keeps some bits of what
stands at the pointer (GRAM characters from it). Likeness is the share of equal samples, less what chance
gives, over the steps that either text has; texts whose samples are all equal have likeness 1.

Bands of sampled bits make candidates for near-duplicates, which are verified by likeness.

Defined results: a null text is empty; an empty text has the fingerprint "0:"; two empty texts are alike
(1), an empty and another are not (0); rows with one id follow each other by text; null ids come last in
descending order; a table of one row has itself as its next document; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._spark import documents, durable, even_keys, lean, partitions, small_batches
from larkspur.llm.components import components

SAMPLES, PERIOD, KINDS, GRAM, SEED = 192, 1 << 14, 256, 3, 20240607
LEAST = 0.8
#: Texts that are walked one by one at the end of a batch, for which lock step would not pay.
FEW = 48
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=1)
def _leaves() -> np.ndarray:
    """For each kind of character and step (modulo PERIOD), how many steps later a walk leaves it."""
    bits = np.random.default_rng(SEED).integers(0, 2, (KINDS, 2 * PERIOD), dtype=np.uint8)
    bits[:, PERIOD:] = bits[:, :PERIOD]
    out = np.zeros((KINDS, PERIOD), np.int32)
    wait = np.full(KINDS, 64, np.int32)
    for t in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(bits[:, t] == 1, 0, np.minimum(wait + 1, 64))
        if t < PERIOD:
            out[:, t] = wait
    return out


@lru_cache(maxsize=1)
def _leaves_bytes() -> bytes:
    return _leaves().astype(np.uint8).tobytes()


@lru_cache(maxsize=1)
def _levels() -> np.ndarray:
    """The highest sample level of each step (modulo 2**20)."""
    h = X.mix(np.arange(1 << 20, dtype=np.uint64) + np.uint64(SEED))
    low = h & (~h + np.uint64(1))
    return np.minimum(np.log2(low.astype(np.float64)), 40).astype(np.int8)


@lru_cache(maxsize=64)
def _steps(level: int) -> np.ndarray:
    """Sampled steps of a level below 2**20."""
    return np.flatnonzero(_levels() >= level)


def sampled_steps(level: int, end: int) -> np.ndarray:
    """Sampled steps of a level below `end`."""
    own, parts, at = _steps(level), [], 0
    while at + (1 << 20) <= end:
        parts.append(own + at)
        at += 1 << 20
    parts.append(own[: np.searchsorted(own, end - at)] + at)
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _symbols(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Four bits of the GRAM characters from each place on (those after the end count as none)."""
    x = np.zeros(len(places), np.uint64)
    for k in range(GRAM):
        at = places + k
        x = x * np.uint64(0x1000193) + np.where(at < len(points), points[np.minimum(at, len(points) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (X.mix(x) & np.uint64(15)).astype(np.uint8)


class Walks:
    """The steps at which walks over several texts come to each of their characters."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.points = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.arrive = np.zeros(len(self.points), np.int64)
        self.end = np.zeros(len(texts), np.int64)
        self.walk(np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64))

    def walk(self, which: np.ndarray, place: np.ndarray, step: np.ndarray) -> None:
        """Walks texts from a place and step on."""
        kinds = ((self.points.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64) * PERIOD
        leaves = _leaves().ravel()
        left = self.sizes[which] - place
        order = np.argsort(-left, kind="stable")
        which, left = which[order], left[order]
        at, step = (self.begin[which] + place[order]), step[order].copy()
        n = len(which)
        # in lock step down to the length of the FEW-th longest text, then the longer ones one by one
        together = int(left[FEW]) if n > FEW else 0
        for t in range(together):
            while left[n - 1] <= t:
                n -= 1
            a = at[:n] + t
            s = step[:n]
            self.arrive[a] = s
            s += leaves[kinds[a] + (s & (PERIOD - 1))] + 1
        self.end[which] = step
        wait, mask = _leaves_bytes(), PERIOD - 1
        for k in range(min(FEW, len(which))):
            a, b, s = int(at[k]) + together, int(at[k] + left[k]), int(step[k])
            arrive = []
            for kind in kinds[a:b].tolist():
                arrive.append(s)
                s += wait[kind + (s & mask)] + 1
            self.arrive[a:b] = arrive
            self.end[which[k]] = s


def _sampled(points: np.ndarray, arrive: np.ndarray, end: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Level, sampled steps and their symbols of one text."""
    level = max(0, (end // SAMPLES).bit_length() - 1)
    steps = sampled_steps(level, end)
    return level, steps, _symbols(points, np.searchsorted(arrive, steps, "right") - 1) if end else np.empty(0, np.uint8)


class Prints:
    """Fingerprints of several texts."""

    def __init__(self, walks: Walks):
        self.items = [_sampled(walks.points[a:b], walks.arrive[a:b], e) for a, b, e in zip(walks.begin[:-1].tolist(), walks.begin[1:].tolist(), walks.end.tolist(), strict=True)]


def as_text(item: tuple[int, np.ndarray, np.ndarray]) -> str:
    return f"{item[0]}:{DIGITS[item[2]].tobytes().decode()}"


def likeness(x: tuple[int, np.ndarray, np.ndarray], y: tuple[int, np.ndarray, np.ndarray]) -> float:
    """0 to 1; the same whichever comes first."""
    level = max(x[0], y[0])
    levels = _levels()
    (s, a), (t, b) = ((i[1], i[2]) if i[0] == level else _coarser(i, level, levels) for i in (x, y))
    n, m = min(len(s), len(t)), max(len(s), len(t))
    if m == 0:
        if not len(x[1]) and not len(y[1]):
            return 1.0
        return 1.0 if len(x[1]) and len(y[1]) and as_text(x) == as_text(y) else 0.0
    # sampled steps are the same for both up to the shorter one's end
    equal = int((a[:n] == b[:n]).sum())
    return max(0.0, (equal - n / 16) / (m - n / 16))


def _coarser(item: tuple, level: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = levels[item[1] & ((1 << 20) - 1)] >= level
    return item[1][keep], item[2][keep]


def parse(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    """A fingerprint read back from its text."""
    level, symbols = fingerprint.split(":")
    level, n = int(level), len(symbols)
    end = max(1, n << level)
    while len(sampled_steps(level, end)) < n:
        end *= 2
    return level, sampled_steps(level, end)[:n], np.array([int(c, 16) for c in symbols], np.uint8)


# --- on Spark ---------------------------------------------------------------------------------------------


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


BATCH = 2 << 20


def _printer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in X.chunks(batch.column(1), BATCH):
            raw = data.tobytes()
            walks = Walks([_points(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            prints = Prints(walks).items
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(walks.sizes), pa.array([as_text(x) for x in prints])], ["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of each row."""
    return documents(docs, id_col, text_col).mapInArrow(lean(_printer), "doc_id long, n_chars long, fingerprint string")


#: Samples under which texts also have bands of SHORT symbols, as one difference may be in each longer band.
FEW_SAMPLES, SHORT = 125, 2


def _bands(digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, bands = [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = parse(text)
                runs = [(item[0], item[2], digits), (item[0] + 1, _coarser(item, item[0] + 1, _levels())[1], digits)]
                if len(item[2]) < FEW_SAMPLES:
                    runs.append((item[0], item[2], SHORT))
                for level, symbols, width in runs:
                    values = DIGITS[symbols].tobytes().decode()
                    own = [f"{level}:{width}:{k}:{values[k : k + width]}" for k in range(0, len(values) - width + 1, width)]
                    bands += own
                    reps += [rep] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(bands, pa.string())], ["rep", "band"])

    return run


def near_pairs(prints: DataFrame, digits: int = 6, least: float = LEAST) -> DataFrame:
    """Verified pairs: a, b (a's id is the lesser) and likeness of at least `least`; they join the same documents
    as all pairs that are so alike and share a band.

    prints: doc_id, fingerprint. Equal fingerprints count once, under their least id. A band is a run of
    `digits` sampled symbols (four bits each), of a stated place, level and value; runs cover the whole sample
    of a text's level and of the next coarser one. A band's members first meet its leader; those that are then
    in different components are compared pair by pair, so many unlike texts with one band cost their square.
    """
    small_batches(prints.sparkSession)
    one = prints.where("length(fingerprint) > 2").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    one = durable(one.select(F.xxhash64("fingerprint").alias("rep"), "doc_id", "fingerprint"), "prints")
    rows = one.select("rep", "fingerprint").mapInArrow(lean(_bands(digits)), "rep long, band string")
    rows = durable(rows, "bands")
    leaders = rows.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = durable(rows.join(leaders, "band").where("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")).distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [likeness(parse(x), parse(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([v >= least for v in like], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(like, pa.float64())], names=["u", "v", "likeness"]).filter(keep)

    def links(pairs: DataFrame) -> DataFrame:
        x, y = (one.select(F.col("rep").alias(k), F.col("fingerprint").alias(name)) for k, name in (("u", "x"), ("v", "y")))
        return durable(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(lean(verify), "u long, v long, likeness double"), "links")

    found = links(met)
    label = durable(components(found.select(F.col("u").alias("a"), F.col("v").alias("b"))), "components")
    members = rows.join(label, rows.rep == label.id, "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = members.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("band")
    members = durable(members.join(mixed, "band"), "rest")
    x, y = members.alias("x"), members.alias("y")
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")))
    rest = rest.select(F.col("x.rep").alias("u"), F.col("y.rep").alias("v")).distinct().join(met, ["u", "v"], "left_anti")
    found = found.unionAll(links(rest))
    x, y = (one.select(F.col("rep").alias(k), F.col("doc_id").alias(name)) for k, name in (("u", "x"), ("v", "y")))
    swap = F.col("x") > F.col("y")
    return found.join(x, "u").join(y, "v").select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), "likeness")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, donor, doc_id, text) in order; a part's last row, a donor, is only the next of the one before."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[3])
            if size > BATCH and len(held) > 1:
                yield _edited(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield _edited(held)


def _edited(rows: list[tuple]) -> pa.RecordBatch:
    """Results for all rows but the last; only of neighbours in one part, and not for donors."""
    texts = [_points(r[3]) for r in rows]
    own = Walks(texts)
    mine = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
    edited = []
    for k in mine:
        cut = len(texts[k]) // 3
        edited.append(np.concatenate([texts[k][: len(texts[k]) - cut], texts[k + 1][:cut]]))
    # an edited text's walk is its document's up to where they differ
    other = Walks.__new__(Walks)
    other.sizes = np.array([len(t) for t in edited], np.int64)
    other.begin = np.concatenate([[0], np.cumsum(other.sizes)])
    other.points = np.concatenate(edited) if edited else np.empty(0, np.uint32)
    other.arrive = np.zeros(len(other.points), np.int64)
    other.end = np.zeros(len(edited), np.int64)
    same = np.array([len(texts[k]) - len(texts[k]) // 3 for k in mine], np.int64)
    step = np.zeros(len(mine), np.int64)
    for e, k in enumerate(mine):
        a, b = int(own.begin[k]), int(other.begin[e])
        other.arrive[b : b + same[e]] = own.arrive[a : a + same[e]]
        step[e] = own.arrive[a + same[e]] if same[e] < len(texts[k]) else own.end[k]
    other.walk(np.arange(len(mine)), same, step)
    x, y = Prints(own).items, Prints(other).items
    sums = [hashlib.sha256(t.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    columns = [
        pa.array([rows[k][2] for k in mine], pa.int64()), pa.array([len(texts[k]) for k in mine], pa.int64()), pa.array(sums, pa.string()),
        pa.array([as_text(x[k]) for k in mine], pa.string()), pa.array([as_text(i) for i in y], pa.string()),
        pa.array([likeness(x[k], i) for k, i in zip(mine, y, strict=True)], pa.float64()), pa.array([likeness(x[k], x[k + 1]) for k in mine], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, by descending id.

    The order is cut into ranges of ids; each range also gets a copy of the next one's first row, so texts
    are shuffled once and no task needs more than its range.
    """
    docs = documents(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)  # at most one per partition
    above = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>"), lambda c: c > F.col("doc_id"))))
    first = docs.select("doc_id").withColumn("part", above).groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()  # a row per range
    heads = [(r.doc_id, first[k - 1].part) for k, r in enumerate(first)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(heads, "head long, before int"))
    rows = docs.withColumn("part", above).join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    to = F.array(F.struct("part", F.lit(0).alias("donor")), F.struct(F.col("before").alias("part"), F.lit(1).alias("donor")))
    rows = rows.withColumn("to", F.explode(to)).where("to.part is not null").select("to.part", "to.donor", "doc_id", "text")
    place = F.element_at(F.array(*(F.lit(k).cast("long") for k in even_keys(docs.sparkSession, n))), F.col("part") + 1)
    rows = rows.repartition(n, place).sortWithinPartitions("part", "donor", F.col("doc_id").desc_nulls_last(), "text")
    return rows.mapInArrow(lean(_in_order), EDITED)
