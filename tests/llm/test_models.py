"""Language ID, quality, language model, fingerprints."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import _blocks, crf_quality, edit_fingerprint, kneser_ney, language_id

TABLE = "/root/testdata/sf0.01/{}.parquet"


def test_language_held_out(spark):
    docs = spark.read.parquet(TABLE.format("documents"))
    out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.where(~out), F.col("text"), F.col("lang"))
    got = language_id.identify(docs.where(out), F.col("lang"), F.col("text"), *model).collect()
    assert sum(r.row == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs, nothing):
    model = language_id.learn(docs, F.col("text"), F.col("lang"))
    assert model[0] == ["en", "fr"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "é"), (4, "é")], "doc_id long, text string")
    got = {(r.row, r.lang_pred == "und", r.score == 0) for r in language_id.identify(odd, F.col("doc_id"), F.col("text"), *model).collect()}
    assert got == {(1, True, True), (2, True, True), (3, True, True), (4, False, False)}
    assert language_id.learn(nothing, F.col("text"), F.col("lang"))[0] == []
    assert language_id.identify(nothing, F.col("doc_id"), F.col("text"), *model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, F.col("doc_id"), F.col("text"), [], np.zeros((0, 512))).collect()} == {"und"}
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and {53, 54, 55} & {r.doc_id for r in kept.collect()} == set()


def test_language_equals_plain_sums(spark, docs, texts):
    """Against one n-gram at a time: products of rotated letter vectors, roots of counts, unit sums."""
    dim, n, seed = 96, 3, 5
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (language_id.CLASSES, dim)).astype(float)

    def kind(ch):
        if not ch.isalpha():
            return 0
        low = ord(ch.lower()[0])
        return low - 96 if 97 <= low <= 122 else 27 + low % (language_id.CLASSES - 27)

    def vector(text):
        line = [0]
        for k in map(kind, f" {text or ''} "):
            line += [k] if k or line[-1] else []
        line += [0] if line[-1] else []
        grams = Counter(tuple(line[i : i + n]) for i in range(len(line) - n + 1) if line[i + n // 2])
        out = np.zeros(dim)
        for gram, count in grams.items():
            bound = np.ones(dim)
            for place, k in enumerate(gram):
                bound = bound * np.roll(letters[k], place)
            out += math.sqrt(count) * bound
        return out / max(np.linalg.norm(out), 1e-9)

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    teach = docs.where("doc_id % 4 <> 2")
    model = language_id.learn(teach, F.col("text"), F.col("lang"), dim, n, seed)
    by = defaultdict(lambda: np.zeros(dim))
    for r in teach.where("lang is not null and text is not null").collect():
        by[r.lang] += vector(r.text)
    protos = unit(np.stack([by[x] for x in model[0]]))
    protos = unit(protos - protos.mean(0))
    got = {r.row: r for r in language_id.identify(docs, F.col("doc_id"), F.col("text"), *model, dim, n, seed).collect()}
    assert np.allclose(model[1], protos, atol=1e-4)
    for d, t in texts.items():
        if t and any(map(str.isalpha, t)):
            cosine = protos @ vector(t)
            assert abs(got[d].score - (1 + cosine.max()) / 2) < 1e-3
            assert got[d].lang_pred == model[0][int(cosine.argmax())] or np.ptp(np.sort(cosine)[-2:]) < 2e-3
        else:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)


def test_language_stage_drops_what_no_row_teaches(spark):
    import random

    r = random.Random(1)
    docs = spark.read.parquet(TABLE.format("documents"))
    odd = [(-1, "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(3000))), (-2, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3), (-3, "人人生而自由，在尊严和权利上一律平等。" * 9), (-4, "12 34"), (-5, "zq xj")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    kept = language_id.keep_known(docs.select("doc_id", "text", "lang").unionByName(more, allowMissingColumns=True))
    ids = {x.doc_id for x in kept.select("doc_id").collect()}
    assert {d for d in ids if d < 0} == {-5}  # too short to tell
    spoken = docs.where("lang is not null and text rlike '\\\\p{L}'").count()
    assert len([d for d in ids if d >= 0]) >= 0.995 * spoken


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(TABLE.format(x)) for x in ("documents", "labels"))
    out = language_id.fold(F.col("doc_id"), 5) == 0
    crf = crf_quality.learn(docs, labels.where(~out))
    got = crf_quality.score(docs, crf, F.col("doc_id"), F.col("text")).withColumnRenamed("row", "doc_id").join(labels.where(out), "doc_id").toPandas()
    bad, good = got[got.quality == 0].score, got[got.quality == 1].score
    assert np.mean([b < g for b in bad for g in good]) > 0.97
    assert ((got.score >= crf_quality.CUT) == (got.quality == 1)).mean() > 0.9


def test_crf_marginals_equal_enumeration():
    import itertools

    rng, same = np.random.default_rng(3), 0.7
    first, emit = np.array([0, 4, 5, 10]), rng.normal(size=10)
    got, pair = crf_quality._marginals(emit, first, same)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, p, stay = 0.0, np.zeros(b - a), np.zeros(b - a)
        for y in itertools.product([0, 1], repeat=b - a):
            w = math.exp(sum(emit[a + i] * v for i, v in enumerate(y)) + same * sum(u == v for u, v in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
            stay[1:] += w * (np.array(y[1:]) == np.array(y[:-1]))
        assert np.allclose(got[a:b], p / total) and np.allclose(pair[a + 1 : b], (stay / total)[1:])


def test_quality_score_equals_a_line_at_a_time(docs, texts):
    """Features of each line in plain Python, all label sequences by their weights, and the mean weighed by length."""
    import itertools
    import re

    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,;:?", "'\"()-", "#$%&*@^~+=<>{}[]\\/_`", "|", "!"]
    kind = lambda b: 10 if b >= 128 else next((k for k, c in enumerate(kinds, 1) if chr(b) in c), 0)

    def own(line, lines):
        words = re.findall(rb"[^\x20\x09-\x0D]+", line)
        some = max(1, len(words))
        share = [sum(kind(b) == k for b in line) / max(1, len(line)) for k in range(11)]
        return share + [
            math.log1p(len(line)) / 8, sum(map(len, words)) / some / 10, sum(len(w) <= 3 for w in words) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
            float(lines.count(line) > 1 and len(line) > 0), float(not line), float(bool(line) and kind(line[-1]) == 5), float(bool(line) and kind(line[0]) == 2),
        ]

    crf = crf_quality.Crf(np.random.default_rng(8).normal(size=crf_quality.N_FEATURES), 0.6)
    plain = ["", "One line.", "A\nA\n\n!! 12 12\nthe end ?", "x|y  |\n\tÉté; no\nshort\n", *[t for t in texts.values() if t and len(t) < 90]]
    rows = docs.sparkSession.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    got = {r.row: r.score for r in crf_quality.score(rows, crf, F.col("doc_id"), F.col("text")).collect()}
    for d, text in enumerate(plain):
        lines = text.encode().split(b"\n")
        each = [own(x, lines) for x in lines]
        emit = [float(np.dot(crf.weights, e + each[max(0, i - 1)] + each[min(len(each) - 1, i + 1)] + [1.0])) for i, e in enumerate(each)]
        total, good = 0.0, np.zeros(len(lines))
        for y in itertools.product([0, 1], repeat=len(lines)):
            w = math.exp(sum(e * v for e, v in zip(emit, y)) + crf.same * sum(a == b for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        weight = np.array([len(x) + 1 for x in lines])
        assert abs(got[d] - (good / total * weight).sum() / weight.sum()) < 1e-6, text


def test_quality_sample_is_bounded_by_whole_documents(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    every, few = (crf_quality.learn(docs, labels, max_bytes=n) for n in (1 << 30, 1500))
    assert len(every.weights) == len(few.weights) and not np.allclose(every.weights, few.weights)
    assert crf_quality.learn(docs, labels, max_bytes=1).prior is not None  # a single document, so labels of one kind


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (50, 0), (56, 1)], "doc_id long, quality int")
    crf = crf_quality.learn(docs, labels)
    got = crf_quality.score(docs, crf, F.col("doc_id"), F.col("text"), lines=True).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and len(r.lines) >= 1 for r in got)
    assert crf_quality.score(nothing, crf, F.col("doc_id"), F.col("text")).count() == 0
    alone = crf_quality.learn(docs, labels.where("quality = 1"))
    assert {r.score for r in crf_quality.score(docs, alone, F.col("doc_id"), F.col("text")).collect()} == {1.0}
    assert crf_quality.learn(docs, labels.limit(0)).prior == 1.0


def reference(train, test):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = lambda t: [*(t or "").encode().translate(lower).split(), None]
    uni, pairs = Counter(), Counter()
    for t in train:
        uni.update(tokens(t))
        pairs.update(zip(["^", *tokens(t)], tokens(t)))
    of = lambda c: kneser_ney.discounts(np.array([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]))
    before = Counter(w for _, w in pairs)
    d2, d1 = of(pairs), of(before)
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    total, rest = Counter(), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        rest[v] += cut(c, d2)
    left = sum(cut(c, d1) for c in before.values()) / len(pairs)

    def p(v, w):
        low = max(before[w] - cut(before[w], d1), 0) / len(pairs) + left / (len(uni) + 1)
        return low if not total[v] else max(pairs[v, w] - cut(pairs[v, w], d2), 0) / total[v] + rest[v] / total[v] * low

    assert all(abs(sum(p(v, w) for w in uni) + p(v, b"?") - 1) < 1e-9 for v in ("^", None, b"the", b"nope"))
    n = sum(uni.values())
    return [(len(x := tokens(t)), sum(uni[w] > 0 for w in x), sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in x), sum(math.log10(p(v, w)) for v, w in zip(["^", *x], x))) for t in test]


def test_kneser_ney_equals_reference(docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(_blocks, "HOLD", 500)
    train = {d: t for d, t in texts.items() if d % 3}
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"), F.col("text"))
    got = {r.row: r for r in kneser_ney.score(docs, model, F.col("doc_id"), F.col("text")).collect()}
    ids = sorted(texts)
    for d, (n, known, base, full) in zip(ids, reference(train.values(), [texts[d] for d in ids]), strict=True):
        assert (got[d].n_tokens, got[d].n_known) == (n, known)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9) and math.isclose(got[d].score, full, rel_tol=1e-9)
    assert kneser_ney.score(nothing, model, F.col("doc_id"), F.col("text")).count() == 0
    none = kneser_ney.train(nothing, F.col("text"))
    assert {r.n_known for r in kneser_ney.score(docs, none, F.col("doc_id"), F.col("text")).collect()} == {0}


def test_blocks_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (_blocks.unpack(_blocks.pack(keys, True), True) == keys).all()


def test_fingerprints(spark, docs, texts, nothing):
    got = {r.doc_id: r for r in edit_fingerprint.edit_test(docs).collect()}
    order = sorted(texts, reverse=True)
    prints = {r.doc_id: r.fingerprint for r in edit_fingerprint.fingerprints(docs).collect()}
    like = lambda x, y: edit_fingerprint.likeness(edit_fingerprint.parse(x), edit_fingerprint.parse(y))
    import hashlib

    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = texts[d] or "", texts[after] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + u[:cut]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        one = edit_fingerprint.Prints(edit_fingerprint.Walks([edit_fingerprint._points(edited)])).items[0]
        assert edit_fingerprint.as_text(one) == got[d].edited_fingerprint
        assert got[d].fingerprint == prints[d] and math.isclose(got[d].near_next, like(prints[d], prints[after]))
        if len(t) > 300 and len(u) > cut and d < 57:
            assert 0.5 < got[d].near_edited < 0.85
    assert prints[50] == prints[51] == prints[3] and prints[53] == prints[54] == "0:"
    assert like(prints[3], prints[50]) == 1 and like(prints[53], prints[3]) == 0
    pairs = edit_fingerprint.near_pairs(edit_fingerprint.fingerprints(docs))
    assert (8, 52) in {(r.a, r.b) for r in pairs.collect()}
    assert edit_fingerprint.edit_test(nothing).count() == 0 and edit_fingerprint.fingerprints(nothing).count() == 0
    alone = edit_fingerprint.edit_test(spark.createDataFrame([(None, "abcdef" * 30)], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def near_components(pairs, ids):
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_near_pairs_join_what_brute_force_joins(spark):
    import itertools
    import random

    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    head, rows = some(300), []
    for n in (4, 12, 60, 124, 190, 250, 380, 900):  # a header that unlike texts share, edits at either end, several levels
        for shared in ("", head):
            base = shared + some(n)
            k, m = max(1, len(base) // 25), len(base)
            rows += [base, some(k) + base[k:], base[: m - k] + some(k), base[: m - k], base + some(k), base[: m // 2] + some(k) + base[m // 2 + k :]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    prints = edit_fingerprint.fingerprints(df)
    of = {x.doc_id: edit_fingerprint.parse(x.fingerprint) for x in prints.collect()}
    pairs = [(x.a, x.b) for x in edit_fingerprint.near_pairs(prints).collect()]
    want = [(a, b) for a, b in itertools.combinations(sorted(of), 2) if edit_fingerprint.likeness(of[a], of[b]) >= edit_fingerprint.LEAST]
    assert set(pairs) <= set(want) and len(want) > 100
    got, whole = near_components(pairs, of), near_components(want, of)
    assert got == whole


@pytest.mark.parametrize("few", [0, 5, 48])
def test_walks_equal_steps(few, monkeypatch):
    import random

    monkeypatch.setattr(edit_fingerprint, "FEW", few)
    r = random.Random(4)
    texts = ["".join(r.choice("abé \n") for _ in range(r.randint(0, 200))) for _ in range(60)]
    w, leaves = edit_fingerprint.Walks([edit_fingerprint._points(t) for t in texts]), edit_fingerprint._leaves()
    for t, a, b, end in zip(texts, w.begin, w.begin[1:], w.end, strict=False):
        s, steps = 0, []
        for c in map(ord, t):
            steps.append(s)
            s += int(leaves[((c * 2654435761) & 0xFFFFFFFF) >> 24, s % edit_fingerprint.PERIOD]) + 1
        assert steps == w.arrive[a:b].tolist() and s == end


def test_even_keys_deal_to_partitions_of_their_own(spark):
    from larkspur.llm._spark import even_keys

    keys = even_keys(spark, 23)
    rows = spark.range(23).repartition(23, F.element_at(F.array(*(F.lit(k).cast("long") for k in keys)), F.col("id").cast("int") + 1))
    assert {r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} == {1}
