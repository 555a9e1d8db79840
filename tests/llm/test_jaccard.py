"""The heavy-light join against all pairs."""

import random

import numpy as np
import pytest

from larkspur.llm import jaccard_join
from larkspur.llm.components import components
from larkspur.llm.jaccard_join import boundary_by_cost, jaccard_classes, keep_one, subset_sums

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sets_of(rows):
    out = {}
    for d, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        out[d] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    return out


def brute(rows):
    s = sets_of(rows)
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(s[a] & s[b])
            if common and 100 * common >= 90 * (len(s[a]) + len(s[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in s}


def variants(seed):
    r = random.Random(seed)
    words, rows = [f"W{i}" for i in range(50)], []
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 12, 13, 22, 25, 32, 70, 130]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                if r.random() < 0.5 and len(w) > 1:
                    w.pop(k)
                else:
                    w.insert(k, r.choice(words))
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = variants(seed)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_shuffled_fetch_and_keep_one(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_IDS", 0)
    rows = variants(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS leader", "1 AS row")
    want = brute(rows)
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def of_rows(rows, words=3, percent=90):
    """Set and component (least row number) of each row by all pairs of different sets, whatever the ids."""
    lower = [(t or "").encode().translate(LOWER).split() for _, t in rows]
    sets = [frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for w in lower]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(rows))]


def check_kept(rows, kept, words, percent):
    """One row of each component, under its least id, and all empty ones."""
    sets, part = of_rows(rows, words, percent)
    size = lambda d: 2**63 if d is None else d
    least = {}
    for (d, _), s, p in zip(rows, sets, part, strict=True):
        if s:
            least[p] = min(least.get(p, 2**64), size(d))
    have = {(d, t): p for (d, t), s, p in zip(rows, sets, part, strict=True) if s}
    full = [(d, t) for d, t in kept if (d, t) in have]
    assert sorted((have[r], size(r[0])) for r in full) == sorted(least.items())
    void = sorted(str(r) for r, s in zip(rows, sets, strict=True) if not s)
    assert sorted(str(r) for r in kept if r not in have) == void


def odd_ids():
    r = random.Random(5)
    a, b, c = ([r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(900)) for _ in range(n)] for n in (30, 200, 40))
    near = [*b[:100], "new", *b[101:]]
    rows = [(3, a), (None, a), (None, b), (9, near), (None, c), (None, c), (5, a), (5, c[:25]), (7, c[:25]), (7, b[50:90])]
    return [*((d, " ".join(w)) for d, w in rows), (None, None), (None, " "), (None, " "), (7, "")]


def test_keep_one_row_of_each_component_whatever_its_id(spark):
    rows = odd_ids()
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check_kept(rows, [tuple(r) for r in kept], 3, 90)


def test_rows_that_share_an_id_with_a_copy_are_counted(spark, monkeypatch):
    rows = odd_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = df.selectExpr("doc_id", "coalesce(text, '') AS text")
    sets, part = of_rows(rows)
    for small in (jaccard_join.SMALL_IDS, 0):
        monkeypatch.setattr(jaccard_join, "SMALL_IDS", small)
        named, once = jaccard_join.one_of_each(jaccard_join._sets(plain, 3))
        full = {x for x in sets if x}
        assert named.count() == len(full)
        assert sorted(r.size for r in once.collect()) == sorted(map(len, full)) and once.select("k1", "k2").distinct().count() == len(full)
    got = jaccard_classes(df).collect()
    id_of = lambda p: min((2**63 if d is None else d) for (d, _), q in zip(rows, part, strict=True) if q == p)
    want = [(d, len(s), (None if id_of(p) == 2**63 else id_of(p)) if s else d) for (d, _), s, p in zip(rows, sets, part, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_duplicates_stage_equals_brute_force(spark):
    import corpus_pipeline

    rows = variants(4)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    check_kept(rows, kept, 5, 80)
    parts = [len(set(of_rows(rows, w, p)[1])) for w, p in ((5, 80), (3, 90))]
    assert parts[0] < parts[1] and len(kept) == parts[0]


def around(seed, n=70, base=200):
    """Variants of one text, most of which link to none or only through another."""
    r = random.Random(seed)
    words = [f"{r.choice('abcdefgh')}{i}" for i in range(base)]
    rows = []
    for d in range(n):
        w = list(words)
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice(([], [f"n{r.randrange(9)}"], [w[k], f"n{r.randrange(9)}"]))
        rows.append((d * 13 % 997, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_variants_that_mostly_do_not_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rows = around(block)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = brute(rows)
    assert 5 < len({c for _, c in want.values()}) < len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_parity_is_a_lower_bound():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 900).astype(np.uint64)
    for n in (0, 5, 200):
        both = np.concatenate([x, x[n:], r.integers(0, 2**63, n).astype(np.uint64)])
        a, b = jaccard_join.parity(both, np.repeat([0, 1], 900), 2)
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= 2 * n and (n or (a == b).all())


def test_empty(nothing):
    assert jaccard_classes(nothing).count() == 0


def test_subsets_meet():
    a = np.array([3, 5, 9, 12, 40, 41, 42, 43, 44, 45, 46], np.uint64)
    have = lambda t: {(*map(int, s), int(n)) for s, n in zip(*subset_sums(t, 1), strict=True)}
    assert have(a) & have(np.delete(a, 3)) and not have(a) & have(a + np.uint64(100))


def test_boundary_follows_cost():
    assert boundary_by_cost({15: 1000}, 100.0, 90) >= 19  # long lists: enumerate
    assert boundary_by_cost({25: 1000}, 1.0, 90) < 29  # short lists: scan


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)]
    random.Random(1).shuffle(path)
    got = {r.id: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1040))
