"""Repeated windows of fixed length, brought together by content without moving the corpus.

Every window of L symbols (bytes or words) is given to its minimizer, the k-gram of least hash in it. Equal
windows have equal minimizers at equal places, so a window can repeat only where its minimizer's hash
repeats. Only the surroundings of repeated minimizers ("regions": the symbols of a run of windows with one
minimizer) travel to the shards, where an index over their symbols decides each window exactly.

Equal regions collapse to one row with a count before they are shuffled. A minimizer that still has very many
different regions is refined: its regions are cut into blocks by the windows' distance from it, and a block's group
also has the hash of the symbols that all its windows share; blocks that are still too large are cut into single
windows, equal to another only as a whole. So a group holds some HOT regions of a bounded length, however often its
minimizer occurs, and a shard of whole groups fits a task. Only different regions are cut, each into no more than
twice as many parts as a level has blocks, and a place in a document keeps one row, whatever the size of its
group; links lead from the parts back to the region. Nothing is dropped but a single window that has no second: a
hash collision only makes a region a candidate.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._spark import durable, lean, partitions

#: Different regions that a single group may hold before it is refined.
HOT = 2000
#: Symbols of one document that are scanned at once.
SEGMENT = 1 << 22
FLUSH = 8 << 20

REGIONS = "kind byte, h long, b int, ckey long, key long, s long, n int, back int, copies long, least long, content binary, up struct<h: long, b: int, ckey: long>"
SCHEMA = pa.schema(
    [("kind", pa.int8()), ("h", pa.int64()), ("b", pa.int32()), ("ckey", pa.int64()), ("key", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("back", pa.int32())]
    + [("copies", pa.int64()), ("least", pa.int64()), ("content", pa.binary()), ("up", pa.struct([("h", pa.int64()), ("b", pa.int32()), ("ckey", pa.int64())]))]
)
#: Kinds of rows: a region's symbols; a place of a region; symbols yet to be refined; a part's place in a region, by level.
SYMBOLS, PLACE, OPEN, LINK = 0, 1, 2, 3
LEVELS = 2
#: Bits of b below its level: 0 for whole regions, then a level's parts.
LEVEL_BITS = 16


@dataclass(frozen=True)
class Units:
    """What a symbol is, how many make a window, and how long the minimizers' k-grams are."""

    kind: str
    length: int
    k: int

    @property
    def width(self) -> int:
        return self.length - self.k + 1

    @property
    def scale(self) -> int:
        return 1 if self.kind == "bytes" else 8

    @property
    def block(self) -> int:
        """Distances in a block: as many as there are blocks."""
        return math.isqrt(self.width - 1) + 1

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bytes":
            return X.byte_symbols(data), offsets
        starts, ends, first = X.word_spans(data, offsets)
        return X.word_hashes(data, starts, ends), first


def _segments(bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first document, bounds, start): documents together while they fit; a longer one in parts that overlap by length-1."""
    if bounds[-1] <= SEGMENT:
        yield 0, bounds, 0
        return
    for i in range(len(bounds) - 1):
        for at in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, SEGMENT):
            yield i, np.array([0, min(int(bounds[i + 1]), at + SEGMENT + length - 1) - at]), at


def _finder(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, _, data, offsets in X.chunks(batch.column(2)):
                symbols, bounds = units.symbols(data, offsets)
                for a, local, at in _segments(bounds, units.length):
                    doc, start, count, back, h = X.minimizers(symbols[at : at + int(local[-1])], local, units.length, units.k)
                    if len(doc):
                        rel = start + at - bounds[doc + a]
                        yield pa.RecordBatch.from_arrays([pa.array(X.signed(h)), pa.array(ids[i + a + doc]), pa.array(keys[i + a + doc]), pa.array((rel << 24) | (count << 12) | back)], ["h", "id", "key", "at"])

    return find


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def _places(found: list[tuple]) -> pa.RecordBatch:
    """Rows of kind PLACE from (h, ckey, key, s, n, id)."""
    named = dict(zip(("h", "ckey", "key", "s", "n", "least"), zip(*found, strict=True), strict=True))
    named |= {"kind": np.full(len(found), PLACE), "b": np.zeros(len(found), np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(named[f.name], f.type) if f.name in named else pa.nulls(len(found), f.type) for f in SCHEMA], schema=SCHEMA)


def _hash(content: bytes) -> int:
    c = xxhash.xxh3_64_intdigest(content)
    return c - ((c >> 63) << 64)


def _regions(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tail, scale = units.length - 1, units.scale

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return _rows([(kind, h, 0, c, None, None, n, back, copies, least, content, None) for (h, c), (kind, n, back, copies, least, content) in held.items()])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(3)
            ends, anchors = lists.offsets.to_pylist(), [lists.values.field(k).to_pylist() for k in range(3)]
            for i, j, data, offsets in X.chunks(batch.column(2)):
                if units.kind == "words":
                    symbols, bounds = units.symbols(data, offsets)
                    raw = symbols.tobytes()
                else:
                    bounds, raw = offsets, data.tobytes()
                found: list[tuple] = []
                for r in range(i, j):
                    base, key, doc = int(bounds[r - i]), keys[r], ids[r]
                    for h, at, hot in dict.fromkeys(zip(*(x[ends[r] : ends[r + 1]] for x in anchors), strict=True)):
                        # windows s .. s+n-1 lie back .. back-n+1 before the minimizer
                        s, n, back = at >> 24, (at >> 12) & 0xFFF, at & 0xFFF
                        content = raw[(base + s) * scale : (base + s + n + tail) * scale]
                        c = _hash(content)
                        got = held.get((h, c))
                        if got is None:
                            held[h, c] = [OPEN if hot else SYMBOLS, n, back, 1, doc, content]
                            size += len(content) + 200
                        else:
                            got[3] += 1
                            got[4] = min(got[4], doc)
                        found.append((h, c, key, s, n, doc))
                if found:
                    yield _places(found)
                if size > FLUSH:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return cut


def _parts(units: Units, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Regions of groups that are too large, in parts with links to them; others as they are."""
    tail, scale = units.length - 1, units.scale
    step = units.block if level == 0 else 1
    first = level + 1 << LEVEL_BITS  # blocks of a level are numbered from here

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for h, b, c, n, back, copies, least, content, large in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not large:
                    rows.append((SYMBOLS, h, b, c, None, None, n, back, copies, least, content, None))
                    size += len(content) + 200
                else:
                    at, far = 0, back
                    while at < n:
                        low = far // step * step
                        m = min(n - at, far - low + 1)
                        # what all windows at distances low .. low+step-1 share
                        core = _hash(content[(back - low) * scale : (back - low - step + 1 + units.length) * scale])
                        part = content[at * scale : (at + m + tail) * scale]
                        group, k = first + far // step, _hash(part)
                        rows.append((LINK + level, core, group, k, None, at, m, None, None, None, None, {"h": h, "b": b, "ckey": c}))
                        rows.append((OPEN, core, group, k, None, None, m, far, copies, least, part, None))
                        size += len(part) + 400
                        at, far = at + m, far - m
                if size > FLUSH:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return cut


def _different(rows: DataFrame) -> DataFrame:
    """Equal regions as one; the aggregation starts before the shuffle, so no region is hot."""
    first = (F.first(c).alias(c) for c in ("n", "back"))
    return rows.groupBy("h", "b", "ckey").agg(*first, F.sum("copies").alias("copies"), F.min("least").alias("least"), F.first("content").alias("content"))


def _refined(regions: DataFrame, units: Units, hot: float, most: int) -> list[DataFrame]:
    """Symbols and links that take the place of the rows of kind OPEN, which are no more than `most`."""
    out, rows = [], regions.where(F.col("kind") == OPEN)
    for level in range(LEVELS):
        # at most one group for `hot` rows
        large = rows.groupBy("h", "b").agg(F.count_distinct("ckey").alias("c")).where(F.col("c") > hot).select("h", "b", F.lit(True).alias("large"))
        marked = _different(rows).join(F.broadcast(large), ["h", "b"], "left").select("h", "b", "ckey", "n", "back", "copies", "least", "content", "large")
        split = durable(marked.mapInArrow(lean(_parts(units, level)), REGIONS), "parts", most=most)
        out.append(split.where(F.col("kind") != OPEN))
        rows = split.where(F.col("kind") == OPEN)
    # a single window equals another only as a whole
    single = _different(rows).where("copies > 1")
    columns = {"kind": F.lit(SYMBOLS), "key": F.lit(None), "s": F.lit(None), "up": F.lit(None)}
    types = {f.name: f.dataType for f in regions.schema}
    return [*out, single.select(*(columns.get(c, F.col(c)).cast(types[c]).alias(c) for c in regions.columns))]


def named(docs: DataFrame) -> DataFrame:
    """With `id` and `key`, by which a row is known: its id (the largest for null) and a hash of its text, so that only
    rows of one id could be taken for one another."""
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("key", F.xxhash64("text"))


def candidates(docs: DataFrame, units: Units, hot: int | None = None) -> DataFrame:
    """Rows of REGIONS: kind 1, where a region lies (document's key and, as least, id; first window, windows); kind 0, a
    region's symbols, with the copies that one task saw and the least doc_id among them; kinds from LINK, where a part
    lies in the region `up`."""
    hot = hot or HOT
    texts = named(docs).select("id", "key", "text")
    found = texts.mapInArrow(lean(_finder(units)), "h long, id long, key long, at long")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # a table of its own, so that the join's large partitions can be split
    often = durable(often.select("h", "c", (F.col("c") > hot).alias("hot")), "minimizers")
    per_doc = found.join(often, "h").groupBy("id", "key").agg(F.collect_list(F.struct("h", "at", "hot")).alias("found"))
    per_doc = durable(per_doc, "anchors")
    joined = texts.join(per_doc, ["id", "key"]).select("key", "id", "text", "found")
    regions = durable(joined.mapInArrow(lean(_regions(units)), REGIONS), "regions")
    most = often.where("hot").agg(F.sum("c").alias("c")).first()["c"]
    if not most:
        return regions
    return functools.reduce(DataFrame.unionAll, _refined(regions, units, hot, most), regions.where(F.col("kind") != OPEN))


def sharded(regions: DataFrame, index: Callable, schema: str, shard_bytes: int) -> DataFrame:
    """Give `index` the regions of a shard: lists of (h, b, ckey), windows, copies, least doc_id and symbols.

    A shard holds whole (h, b) groups of about shard_bytes; all occurrences of a window are in one group.
    """
    spark = regions.sparkSession
    rows = regions.where("kind = 0").select("h", "b", "ckey", "n", "copies", "least", "content")
    rows = rows.repartition(partitions(spark), "h", "b").sortWithinPartitions("h", "b", "ckey")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple] = []
        rest: tuple[list, list, list, list] = ([], [], [], [])
        size, last = 0, None
        for batch in batches:
            for h, b, c, n, copies, least, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if last == (h, b, c):
                    rest[1][-1] += copies
                    rest[2][-1] = min(rest[2][-1], least)
                    continue
                if size > shard_bytes and (h, b) != last[:2]:
                    yield from index(ids, *rest)
                    ids, rest, size = [], ([], [], [], []), 0
                last = (h, b, c)
                ids.append(last)
                for x, v in zip(rest, (n, copies, least, content), strict=True):
                    x.append(v)
                size += len(content)
        if ids:
            yield from index(ids, *rest)

    return rows.mapInArrow(lean(run), schema)


def _joined_runs(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for parts in batch.column(3).to_pylist():
                moved = [np.frombuffer(x["runs"], np.int64).reshape(-1, columns) + [x["s"], *[0] * (columns - 1)] for x in parts]
                runs.append(np.concatenate(moved).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(runs, pa.binary())], ["h", "b", "ckey", "runs"])

    return join


def spread(docs: DataFrame, regions: DataFrame, shards: Callable[[DataFrame], DataFrame], columns: int) -> DataFrame:
    """Documents with `spans`: what the shards find (h, b, ckey, runs of so many columns, the start first), at each place
    where such a region lies."""
    keys = ["h", "b", "ckey"]
    if regions.where(F.col("kind") >= LINK).isEmpty():
        found = shards(regions)
    else:
        whole = None
        for level in range(LEVELS, -1, -1):
            # a range, by which a scan can leave out files of other levels
            found = shards(regions.where(F.col("b").between(level << LEVEL_BITS, (level + 1 << LEVEL_BITS) - 1)))
            found = found if whole is None else found.unionAll(whole)
            if level:
                links = regions.where(F.col("kind") == LINK + level - 1).select(*keys, "s", "up")
                parts = links.join(found, keys).groupBy("up").agg(F.collect_list(F.struct("s", "runs")).alias("parts"))
                whole = parts.select(*(f"up.{k}" for k in keys), "parts").mapInArrow(lean(_joined_runs(columns)), found.schema)
    places = regions.where(F.col("kind") == PLACE).select(*keys, F.col("least").alias("id"), "key", "s")
    spans = durable(places.join(found, keys).groupBy("id", "key").agg(F.collect_list(F.struct("s", "runs")).alias("spans")), "spans")
    return named(docs).join(spans, ["id", "key"], "left").select("doc_id", "text", "spans", *(c for c in docs.columns if c == "row"))
