"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import _anchors, suffix_sort
from larkspur.llm.fm_index import FMIndex
from larkspur.llm.substring_dedup import substring_dedup
from larkspur.llm.suffix_dedup import remove_repeats, suffix_dedup
from larkspur.llm.suffix_sort import sorted_suffixes


def repeated_bytes(rows, n):
    """Brute force: per (id, text) row the removed flags."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + n] for _, b in bodies for i in range(len(b) - n + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def earlier_words(rows, n):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(40))
def test_external_induced_sorting(seed, tmp_path, monkeypatch):
    r = random.Random(seed)
    t = [r.randint(1, r.choice([1, 2, 9])) for _ in range(r.randint(0, 200))]
    t = t + t[3 : 3 + len(t) // 2] + t[:5] + [0]
    monkeypatch.setattr(suffix_sort, "BLOCK", r.choice([3, 1 << 16]))
    parts = list(sorted_suffixes(np.array(t, np.uint16), str(tmp_path), memory=r.choice([64, 1 << 20]), base=r.choice([2, 1 << 20])))[::-1]
    sa, lcp = (np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1))
    assert sa == sorted(range(len(t)), key=lambda i: t[i:])

    def common(i, j):
        k = 0
        while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
            k += 1
        return k

    assert lcp == [0] + [common(a, b) for a, b in zip(sa, sa[1:])]
    assert not list(tmp_path.iterdir())  # queues' files are gone


@pytest.mark.parametrize("seed", range(20))
def test_fm_index_matching_statistics(seed):
    r = random.Random(seed)
    make = lambda most, n: [np.array([r.randint(5, most) for _ in range(r.randint(1, 30))], np.uint64) for _ in range(n)]
    indexed, asked, limit = make(r.choice([6, 9, 40]), r.randint(1, 8)), make(10, 4), r.choice([3, 8])
    have = {tuple(s[i:j].tolist()) for s in indexed for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for q, at, size, _ in FMIndex(indexed, limit).matches(asked):
        for x, p, z in zip(q, at, size, strict=True):
            t, m = asked[x].tolist(), 0
            while m < limit and p + m < len(t) and tuple(t[p : p + m + 1]) in have:
                m += 1
            assert m == z


def test_fm_index_is_smaller_than_its_symbols():
    r = np.random.default_rng(2)
    words = r.integers(1, 2**63, 900).astype(np.uint64)
    passages = [words[r.integers(0, 900, 90)] for _ in range(40)]
    sequences = [np.concatenate([words[r.integers(0, 900, 20)], passages[r.integers(0, 40)]]) for _ in range(400)]
    index = FMIndex(sequences, 50)
    least = np.arange(400)
    of_class = index.least_of_class(least)
    assert not hasattr(index, "_places") and index.nbytes < sum(map(len, sequences)) * 8 * 0.6
    bits = np.unpackbits(index.edges.words.view(np.uint8), bitorder="little")
    at = np.flatnonzero(bits)
    assert (index.edges.select1(np.arange(len(at))) == at).all() and len(of_class) < len(at)


@pytest.mark.parametrize("split", [False, True])
def test_suffix_dedup(docs, texts, split, monkeypatch):
    if split:
        monkeypatch.setattr(_anchors, "HOT", 2)
        monkeypatch.setattr(_anchors, "SEGMENT", 1500)
    got = suffix_dedup(docs, 100, digest=True, shard_bytes=4000).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeated_bytes(texts.items(), 100)


@pytest.mark.parametrize("split", [False, True])
def test_substring_dedup(docs, texts, split, monkeypatch):
    if split:
        monkeypatch.setattr(_anchors, "HOT", 2)
        monkeypatch.setattr(_anchors, "SEGMENT", 100)
    got = substring_dedup(docs, 20, digest=True, shard_bytes=4000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == earlier_words(texts.items(), 20)


@pytest.mark.parametrize("hot", [1e-2, 0.5, 3])
def test_hot_minimizers_in_bounded_groups(spark, hot, monkeypatch):
    """One passage in many documents: blocks by distance, then by content."""
    monkeypatch.setattr(_anchors, "HOT", hot)
    r = random.Random(7)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(n))
    passage = text(30)
    rows = [(k, f"{text(k % 7)} {passage} {text(k % 5 + 3)}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup(df, 60, digest=True, shard_bytes=2000).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeated_bytes(rows, 60)
    got = substring_dedup(df, 12, digest=True, shard_bytes=2000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == earlier_words(rows, 12)
    units = _anchors.Units("bytes", 60, 30)
    groups = _anchors.candidates(df, units).where("kind = 0").groupBy("h", "b").agg(F.count_distinct("ckey").alias("n"), F.max(F.octet_length("content")).alias("size")).agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
    if hot < 0.1:
        assert groups["size"] <= 60 and groups.n <= 12  # single windows, dealt by content


@pytest.mark.parametrize("units", [_anchors.Units("bytes", 60, 30), _anchors.Units("words", 12, 6)])
def test_rows_of_a_hot_group_grow_with_the_group(spark, units):
    """One passage in 20 and in 80 documents: four times as many rows, not sixteen, and a place a region."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(n))
    passage = text(30)
    rows = [(k, f"{text(14)} {passage} {text(14)}") for k in range(80)]

    def counted(n, hot):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(3)
        made = _anchors.candidates(df, units, hot).groupBy("kind").count().collect()
        return {x["kind"]: x["count"] for x in made}

    few, many, whole = counted(20, 2), counted(80, 2), counted(80, 1000)
    assert many[1] == whole[1]
    assert sum(many.values()) < 5 * sum(few.values())
    assert len(many) > len(whole)  # the group was refined


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + " y")], "doc_id long, text string")
    got = substring_dedup(df, 50).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, None, 60)]
    got = suffix_dedup(df, 100).collect()
    assert all(r.n_removed == len(t) for r in got) and len(got) == 4


def test_empty_table_and_other_columns(nothing, docs):
    assert suffix_dedup(nothing).count() == 0 and substring_dedup(nothing).count() == 0
    got = remove_repeats(docs, 100)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert got.where("key = 'clash' and size = 7").count() == docs.count()
