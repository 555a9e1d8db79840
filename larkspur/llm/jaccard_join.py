"""N-gram Jaccard join: the size-aware heavy-light join of distinct word shingles.

Equal sets are one class. Of different sets, small ones (up to a size chosen by cost) enumerate fixed-size
subsets: two sets that link have their intersection in common, and it lacks at most a tenth of either. Within
those that share a subset, each links to the smallest, and only if the sizes allow; two that don't link to it
don't link to each other by that subset, so stars lose nothing.

Large sets scan inverted lists, of which those of a set's first tokens are enough (as many as it may lack,
and one) when all sets order tokens alike. Tokens come in order of document frequency, counted over all
different sets, so tokens of one document, which no list needs, come first and the lists scanned are short. A
list's sets first meet a pivot each. What is then still in different components is compared within the list, by
bounds that no linked pair can miss: sizes, tokens of one document, places of the common token, and parity
bitmaps (each token flips one bit of 1024; bits that differ are at most the tokens that differ). Only pairs within
all bounds leave the join and are compared token by token, so every pair is compared, excluded or joined by others.

Defined results: texts without words, and null texts, have an empty set and link with nothing; fewer words
than a shingle make one shingle; rows with one doc_id are separate sets under that id; a null id counts
as the largest and is returned as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import _text as X
from larkspur.llm._blocks import BLOCK, blocks, by_range, ensure, gathered, map_array, merged, write_array
from larkspur.llm._spark import cached, documents, durable, input_parts, lean, new_path, partitions, release, workspace
from larkspur.llm.components import components

WORDS, PERCENT = 3, 90
NO_ID = 2**63 - 1
#: Ids that may be broadcast; of more, the sets are fetched by a shuffled join.
SMALL_IDS = 100_000
BOUNDARIES = (9, 19, 29)
#: Distinct tokens that a task counts before it sends its blocks.
HOLD = 1 << 19
#: Tokens, copies of a token in several tasks among them, of a partition that one task merges.
MERGED = 1 << 20
#: Sets of a list whose bounds a join checks at the cost of making and shuffling one subset.
CHECKS = 10
#: Words of 64 bits in a parity bitmap.
PARITY = 16
#: Sets of one list that are compared in one group; of longer lists, each pair of blocks is a group.
LIST_BLOCK = 4096


def lacking(size: int, percent: int) -> int:
    """How many of a set's elements another set that links with it may lack."""
    return size * (100 - percent) // 100


def prefix_length(size: int, percent: int) -> int:
    return lacking(size, percent) + 1 if size else 0


# --- document frequencies -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Frequencies:
    """Tokens that several documents have, by their leading bits, in sorted arrays with the log2 of their number.

    Two tokens that agree in those bits count as one, which changes the order of tokens, never a result.
    """

    path: str
    parts: int
    bits: int

    def heads(self, tokens: np.ndarray) -> np.ndarray:
        return tokens & ~np.uint64((1 << (64 - self.bits)) - 1)

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens of one document, else 1 + log2 of the number of documents."""
        different, inverse = np.unique(self.heads(tokens), return_inverse=True)
        out = np.zeros(len(different), np.uint8)
        part = by_range(self.parts)(different)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            have, kinds = _arrays(self, int(part[a]))
            if len(have):
                at = np.minimum(np.searchsorted(have, different[a:b]), len(have) - 1)
                out[a:b] = np.where(have[at] == different[a:b], kinds[at], 0)
        return out[inverse]


@cached("jaccard", 4096)
def _arrays(f: Frequencies, part: int) -> tuple[np.ndarray, np.ndarray]:
    return map_array(f"{f.path}/tokens-{part}", np.uint64), map_array(f"{f.path}/classes-{part}", np.uint8)


def frequencies(sets: DataFrame) -> Frequencies:
    """Of sets (size, tokens)."""
    spark = sets.sparkSession
    size = sets.agg(F.sum("size")).first()[0] or 0
    f = Frequencies(new_path(spark, "frequencies"), partitions(spark, -(-size // MERGED)), min(64, max(24, int(size).bit_length() + 13)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, _, tokens, _ in token_chunks(batch.column(0)):
                    yield np.unique(f.heads(tokens), return_counts=True)

        return blocks(parts(), by_range(f.parts), HOLD)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, counts in merged(batches, HOLD // 2):
            many = counts[:, 0] > 1
            write_array(f"{f.path}/tokens-{p}", keys[many])
            write_array(f"{f.path}/classes-{p}", np.minimum(1 + np.log2(counts[many, 0]), 63).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["p"])

    have = {r.p for r in gathered(sets.select("tokens").mapInArrow(lean(count, "jaccard"), BLOCK), f.parts).mapInArrow(lean(write, "jaccard"), "p int").collect()}
    for p in set(range(f.parts)) - have:
        ensure(f"{f.path}/tokens-{p}", np.uint64)
        ensure(f"{f.path}/classes-{p}", np.uint8)
    release(spark)
    return f


# --- sets -------------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of all documents, sorted within each, and where each document's begin (n+1 long)."""
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets)
    prefix = X.PrefixHash(X.word_hashes(data, starts, ends))
    count = np.diff(first)
    m = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), m)
    begin = np.concatenate([[0], np.cumsum(m)])
    at = first[doc] + np.arange(len(doc)) - begin[doc]
    token = prefix.spans(at, np.minimum(at + words, first[doc + 1]))
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]) if len(token) else np.empty(0, bool)
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(count) + 1))


def token_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, where each row's begin) of runs of rows of stored sets."""
    for i, j, data, offsets in X.chunks(column, 2 * X.CHUNK_BYTES):
        yield i, j, np.frombuffer(data.tobytes(), np.uint64), offsets // 8


def _tokens(words: int):
    """(row, doc_id, text_id, text) to the sets: their hash of 128 bits, size and sorted tokens."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in X.chunks(batch.column(3)):
                tokens, first = shingles(data, offsets, words)
                raw, ends = tokens.tobytes(), (8 * first).tolist()
                sets = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
                some = [batch.column(k).slice(i, j - i) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*some, pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(np.diff(first)), pa.array(sets, pa.binary())], ["row", "doc_id", "text_id", "k1", "k2", "size", "tokens"])

    return make


def of_rows(sets: DataFrame, rows: DataFrame, anti: bool = False) -> DataFrame:
    """Those sets whose `row` is among `rows`, or with anti is not; few rows are broadcast."""
    return sets.join(F.broadcast(rows) if rows.count() <= SMALL_IDS else rows, "row", "left_anti" if anti else "left_semi")


def _list_maker(percent: int, order: Frequencies):
    """(row, tokens) to what the join needs of a set: lists of its first tokens in order, the small sets, the parity bitmap."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, first in token_chunks(batch.column(1)):
                size = np.diff(first)
                klass = order.classes(tokens)
                doc = np.repeat(np.arange(len(size)), size)
                # tokens are sorted within a set, and so stay within a class
                ranked = np.argsort((doc << 6) | klass, kind="stable")
                rank = np.arange(len(tokens)) - first[doc]
                head = ranked[rank < size[doc] * (100 - percent) // 100 + 1]
                head = head[klass[head] > 0]
                own = size - np.bincount(doc[klass > 0], minlength=len(size))  # tokens that no other set has
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[head], np.arange(len(size) + 1)).astype(np.int32)), pa.array(X.signed(tokens[head])))
                few = np.where(size <= BOUNDARIES[-1], size, 0)
                ends = np.cumsum(few)
                pick = np.repeat(first[:-1] - (ends - few), few) + np.arange(int(few.sum()))
                small = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(X.signed(tokens[pick])))
                bits = parity(tokens, doc, len(size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(own), small, lists, *(pa.array(bits[:, k].copy()) for k in range(PARITY))], ["row", "size", "own", "small", "lists", *BITS])

    return make


BITS = [f"p{k}" for k in range(PARITY)]


def parity(tokens: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets a bitmap, as int64 words, in which each token has flipped one bit."""
    wide = 64 * PARITY
    at = (X.mix(tokens * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - wide.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(doc * wide + at, minlength=n * wide).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, wide), axis=1, bitorder="little").view(np.int64)


# --- small sets -------------------------------------------------------------------------------------------


def subset_sums(tokens: np.ndarray, lack: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-part hashes and sizes of all subsets that lack up to `lack` (at most 2) of the tokens."""
    parts = np.stack([X.mix(tokens), X.mix(tokens * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))], 1)
    total, n = parts.sum(0), len(tokens)
    sums, sizes = [total[None]], [np.array([n])]
    if lack >= 1:
        sums.append(total - parts)
        sizes.append(np.full(n, n - 1))
    if lack >= 2:
        a, b = np.triu_indices(n, 1)
        sums.append(total - parts[a] - parts[b])
        sizes.append(np.full(len(a), n - 2))
    return np.concatenate(sums), np.concatenate(sizes)


def _subsets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, small in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = small.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(tokens):
                    sums, sizes = subset_sums(tokens, lacking(len(tokens), percent))
                    out.append((sums, sizes, rep, len(tokens)))
            if out:
                sums = np.concatenate([x[0] for x in out]).view(np.int64)
                n = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.repeat([x[2] for x in out], n)), pa.array(np.repeat([x[3] for x in out], n))], ["s1", "s2", "common", "rep", "size"])

    return run


def light_edges(small: DataFrame, percent: int) -> DataFrame:
    """Links between small sets: rep, small (all tokens)."""
    n = small.count()
    subsets = durable(small.select("rep", "small").mapInArrow(lean(_subsets(percent), "jaccard"), "s1 long, s2 long, common long, rep long, size long"), "subsets", most=100 * n)
    least = subsets.groupBy("s1", "s2", "common").agg(F.min(F.struct("size", "rep")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = subsets.join(least, ["s1", "s2", "common"]).where(f"100 * common >= {percent} * (size + least.size - common) and rep <> least.rep")
    return met.select(F.col("rep").alias("a"), F.col("least.rep").alias("b"))


# --- large sets -------------------------------------------------------------------------------------------


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                both = np.concatenate([u, v])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _differ(x: str, y: str) -> str:
    """At least so many tokens are in one of two sets only."""
    return " + ".join(f"bit_count({x}.{b} ^ {y}.{b})" for b in BITS)


@dataclass
class _Comparison:
    """Fetches and compares the sets of pairs."""

    sets: DataFrame  # row, tokens
    reps: DataFrame  # rep, size, bitmaps
    percent: int

    def plausible(self, pairs: DataFrame, most: int) -> DataFrame:
        """Pairs (a, b), of at most `most`, whose bitmaps allow a link."""
        x, y = (self.reps.select("rep", "size", *BITS).alias(n) for n in "xy")
        both = pairs.join(x, F.col("a") == F.col("x.rep"))
        allowed = f"{100 - self.percent} * (x.size + y.size) >= {100 + self.percent} * ({_differ('x', 'y')})"
        return durable(both.join(y, (F.col("b") == F.col("y.rep")) & F.expr(allowed)).select("a", "b"), "plausible", most=most)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose Jaccard similarity is at least percent/100."""
        n = pairs.count()
        wanted = durable(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct(), "wanted", most=2 * n)
        tokens = durable(of_rows(self.sets, wanted), "tokens", "uncompressed", 20 * wanted.count())  # a set is some twenty rows of a few numbers
        both = pairs.join(tokens.select(F.col("row").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("row").alias("b"), F.col("tokens").alias("y")), "b")
        return durable(both.select("a", "b", "x", "y").mapInArrow(lean(_verifier(self.percent), "jaccard"), "a long, b long"), "links", most=20 * n)


def _labelled(live: DataFrame, label: DataFrame) -> DataFrame:
    return live.join(label, live.rep == label.id, "left").drop("id").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _possible(percent: int, x: str, y: str, boundary: int) -> str:
    """Whether two sets can link by their sizes, by the tokens that others have and by where the token that they share stands, and not both are small.

    Of the first token that they share: all that they share further stands behind it in both.
    """
    low, high = f"least({x}.size, {y}.size)", f"greatest({x}.size, {y}.size)"
    common = f"{100 + percent} * least({x}.size - greatest({x}.own, {x}.at), {y}.size - greatest({y}.own, {y}.at)) >= {percent} * ({x}.size + {y}.size)"
    return f"100 * {low} >= {percent} * {high} and {high} > {boundary} and {common}"


def _rest(members: DataFrame, percent: int, boundary: int, block: int, n: int) -> DataFrame:
    """Pairs (a, b) of sets of one list, in different components, that all bounds allow; members (n): list, rep, size, own, at, c, bitmaps."""
    sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "list").withColumn("own_block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own_block").alias("i"), F.greatest(k, "own_block").alias("j")))
    rows = durable(rows.withColumn("cell", F.explode(cells)).drop("blocks"), "cells", most=4 * n)
    x, y = rows.alias("x"), rows.alias("y")
    allowed = f"x.rep < y.rep and x.c <> y.c and (x.own_block <> y.own_block or x.cell.i = x.cell.j) and {_possible(percent, 'x', 'y', boundary)} and {100 - percent} * (x.size + y.size) >= {100 + percent} * ({_differ('x', 'y')})"
    pairs = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.cell") == F.col("y.cell")) & F.expr(allowed))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def boundary_by_cost(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which subsets cost less: their number against tokens scanned and the bounds checked in the mean list met."""

    def subsets(s: int) -> int:
        d = lacking(s, percent)
        return 1 + (s if d >= 1 else 0) + (s * (s - 1) // 2 if d >= 2 else 0)

    def cost(x: int) -> float:
        return sum(n * (subsets(s) if s <= x else prefix_length(s, percent) * (1 + list_length / CHECKS)) for s, n in sizes.items())

    usable = [b for b in BOUNDARIES if lacking(b, percent) <= 2]
    return min(usable, key=lambda b: (cost(b), b)) if usable else 0


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """row (unique), doc_id, text_id, k1, k2, size, tokens of documents (doc_id, text), each tokenised once."""
    rows = input_parts(docs).select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return durable(rows.mapInArrow(lean(_tokens(words), "jaccard"), "row long, doc_id long, text_id long, k1 long, k2 long, size long, tokens binary"), "sets", "uncompressed")


def one_of_each(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (k1, k2, least: their least doc_id, rep: its row), and those rows' sets."""
    some, n = sets.where("size > 0"), sets.count()
    reps = durable(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("n")).select("k1", "k2", "n", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("least")), "classes", most=n)
    copied = reps.where("n > 1").select("k1", "k2", "rep")
    copies = durable(some.select("k1", "k2", "row").join(copied, ["k1", "k2"]).where("row <> rep").select("row"), "copies", most=n)
    return reps.select("k1", "k2", "rep", "least"), of_rows(some, copies, anti=True)


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id (NO_ID for null), text_id, size, and the component and its least doc_id (null for empty sets) of each row."""
    with workspace(docs.sparkSession) as keep:
        sets = _sets(documents(docs, id_col, text_col), words)
        return keep(_linked(sets, percent), "components", sets.count())


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    named, once = one_of_each(sets)
    order = frequencies(once)
    reps = once.select("row", "tokens").mapInArrow(lean(_list_maker(percent, order), "jaccard"), f"row long, size long, own long, small array<long>, lists array<long>, {', '.join(f'{b} long' for b in BITS)}")
    reps = durable(reps.withColumnRenamed("row", "rep"), "heads")
    n = reps.agg(F.sum(F.size("lists")).alias("n")).first().n or 0
    n = 2 * n  # postings

    # sizes that can link lie in one or two neighbouring bands; a set joins the lists of its band and the next
    band = F.floor(F.log(F.col("size").cast("double") + 1e-9) / F.log(F.lit(100.0 / percent)) - 1e-9).cast("int")
    postings = reps.select("rep", "size", "own", F.posexplode("lists").alias("k", "token")).withColumn("band", F.explode(F.array(band, band + 1)))
    postings = postings.select("rep", "size", "own", (F.col("own") + F.col("k")).alias("at"), F.struct("token", "band").alias("list"))
    lists = durable(postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists", most=n)
    mean = lists.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    histogram = {r["size"]: r["n"] for r in reps.where(F.col("size") <= 2 * BOUNDARIES[-1]).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    boundary = boundary_by_cost(histogram, mean, percent)

    live = durable(postings.where(F.col("size") * 100 > boundary * percent).join(lists.select("list"), "list"), "postings", most=n)
    compare = _Comparison(sets.select("row", "tokens"), reps, percent)
    links = durable(light_edges(reps.where(F.col("size") <= boundary), percent), "links", most=100 * sum(histogram.values()))
    tested = label = None
    for turn in range(2):
        members = live.withColumn("c", F.col("rep")) if turn == 0 else _labelled(live, label)
        member = F.struct("own", "rep", "size", "at", "c")  # the pivot has fewest tokens of its own: it is nearest to what the others vary
        if turn == 0:
            pivots = members.groupBy("list").agg(F.min(member).alias("p"))
        else:  # a pivot outside the first one's component
            lowest = members.groupBy("list").agg(F.min_by("c", member).alias("c0"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
            pivots = members.join(lowest, "list").where("c <> c0").groupBy("list").agg(F.min(member).alias("p"))
        pairs = members.select("list", member.alias("m")).join(pivots, "list").where("m.c <> p.c and " + _possible(percent, "m", "p", boundary))
        pairs = pairs.select(F.least("m.rep", "p.rep").alias("a"), F.greatest("m.rep", "p.rep").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = compare.plausible(pairs, n)
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = links.unionAll(compare.links(pairs))
        label = components(links)
    # what is left: pairs of a list that lie in different components and were not compared
    members = _labelled(live, label)
    mixed = members.groupBy("list").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("list")
    members = durable(members.join(mixed, "list").join(reps.select("rep", *BITS), "rep"), "rest", most=4 * n)
    rest = durable(_rest(members, percent, boundary, LIST_BLOCK, n).join(tested, ["a", "b"], "left_anti"), "pairs", most=n)
    label = components(links.unionAll(compare.links(rest)))

    named = named.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "component", "component_id")
    return sets.select("doc_id", "text_id", "size", "k1", "k2").join(named, ["k1", "k2"], "left").drop("k1", "k2")


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links of at least percent/100 similarity)."""
    out = _classes(docs, words, percent, id_col, text_col)
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("size").alias("n_shingles"), F.nullif(own, F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` of each component, of its least id, and all rows with an empty set.

    Of a component's rows under its least id, that whose text has the least hash stays, and one of equal texts.
    """
    key, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = _classes(docs, words, percent, id_col, text_col)
    leaders = found.where("size > 0 and doc_id = component_id").groupBy("component").agg(F.min("doc_id").alias("leader"), F.min("text_id").alias("text_id"))
    empty = found.where("size = 0").select(F.col("doc_id").alias("leader"), "text_id", F.lit(True).alias("empty")).distinct()
    kept = leaders.select("leader", "text_id", F.lit(False).alias("empty")).unionAll(empty)
    rows = docs.select(key.alias("leader"), F.xxhash64(text).alias("text_id"), F.struct("*").alias("row")).join(kept, ["leader", "text_id"])
    each = F.when(F.col("empty"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    rows = rows.withColumn("each", each).dropDuplicates(["leader", "text_id", "each"])
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns))
