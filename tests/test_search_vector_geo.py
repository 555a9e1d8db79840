"""Analyzers, edit distance, fragments, vectors, geo covers, and queries against SQL."""

import itertools
import math
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur import registry
from larkspur.operators import geo as G
from larkspur.operators import search as Q
from larkspur.operators import vector as V

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, FOLDER), con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(cell(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0


def test_analyzers(spark):
    df = spark.createDataFrame([("The Dog's naïve-été 42 running!",)], "t string")
    tokens = lambda a: df.select(Q.analyze(a, F.col("t")).alias("x")).first().x
    assert tokens("standard") == ["the", "dog's", "naïve", "été", "42", "running"]
    assert tokens("folding")[2:4] == ["naive", "ete"]
    assert tokens("english") == ["dog", "naïv", "été", "42", "run"]
    assert tokens("keyword") == ["The Dog's naïve-été 42 running!"]
    assert tokens("whitespace | lowercase | stopwords(the)")[0] == "dog's"
    assert df.select(Q.analyze("ngram(2,3)", F.lit("abcd")).alias("x")).first().x == ["ab", "abc", "bc", "bcd", "cd"]
    for a in ("standard", "folding", "english", "french", "whitespace | lowercase", "unicode | lowercase | ascii_folding | stopwords(the,42)", "ngram(2,3)", "edge_ngram(1,4)", "regex((dog|run)) | stem(german) | lowercase", "unicode | alphanum_only | remove_long(5) | stop(english)"):
        assert tokens(a) == Q.analyze_text(a, "The Dog's naïve-été 42 running!")
    for bad in ("nosuch", "unicode | frobnicate", "unicode | stop(klingon)", "unicode | remove_long(0)", "unicode | | lowercase", "unicode | stopwords()", "whitespace(8) | lowercase", "ngram(3,2)", " | ".join(["unicode", *["lowercase"] * 17])):
        with pytest.raises((ValueError, re.error)):
            tokens(bad)


def test_words_and_languages(spark):
    tokens = lambda a, text: Q.analyze_text(a, text)
    assert tokens("standard", "3.14 or 1,000; a.b c:d x.1 e-mail __ _a 東京カタ") == ["3.14", "or", "1,000", "a.b", "c:d", "x", "1", "e", "mail", "_a", "東", "京", "カタ"]
    sentence = "Nobody's 2 LAZY cats were happily jumping over five-foot fences."
    assert tokens("english", sentence) == ["nobodi", "2", "lazi", "cat", "were", "happili", "jump", "over", "five", "foot", "fenc"]
    assert tokens("french", "les nations magnifiques chantaient") == ["nation", "magnif", "chant"]
    assert tokens("german", "die Bücher und Kategorien") == ["buch", "kategori"]
    assert tokens("swedish", "och flickorna") == ["flick"] and tokens("spanish", "las canciones") == ["cancion"]
    assert tokens("russian", "важнейшими") == ["важн"] and tokens("tamil", "word words") == ["word", "words"]


@pytest.mark.parametrize("analyzer,text,found", [("folding", "café", 1), ("ngram(3,5)", "noir", 1), ("english", "CHAIRS", 2), ("unicode | lowercase | stopwords(noir)", "noir", 0), ("standard", "café", 0), ("regex([a-z]+)", "noir", 1)])
def test_queries_are_analyzed_as_the_index_is(spark, analyzer, text, found):
    docs = spark.createDataFrame([(1, "Cafe noir"), (2, "a chair"), (3, "two chairs"), (4, None)], "id int, t string")
    ix = Q.Index(docs, "id", [Q.TextField("t", analyzer)])
    assert Q.search(ix, Q.Match(["t"], text)).count() == found


def test_a_saved_index_is_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} all") for k in range(60)], "id int, t string")
    fields = [Q.TextField("t", copy_to="every"), Q.TextField("t", "keyword", alias="t.keyword")]
    plain, saved = Q.Index(docs, "id", fields), Q.Index(docs, "id", fields).saved(str(tmp_path / "ix"))
    again = Q.Index.opened(docs, "id", fields, str(tmp_path / "ix"))
    for q in (Q.Match(["t"], "w3 w4"), Q.Match(["every"], "w1"), Q.MatchPhrase("t", "w2 w2"), Q.Match(["t.keyword"], "w1 w1 all"), Q.Match([], "all")):
        want = sorted((r.id, round(r._score, 9)) for r in Q.search(plain, q).collect())
        for ix in (saved, again):
            assert sorted((r.id, round(r._score, 9)) for r in Q.search(ix, q).collect()) == want and want


def osa(a, b):
    """Edits by search over all strings that one edit makes."""
    seen, now = {a}, {a}
    for d in range(4):
        if b in now:
            return d
        more = set()
        for w in now:
            for i in range(len(w) + 1):
                more |= {w[:i] + c + w[i:] for c in b}
                if i < len(w):
                    more |= {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in b}
        now = more - seen
        seen |= more
    return 4


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=4), st.text("abc", min_size=1, max_size=4))
def test_edit_distance(a, b):
    plain, got = osa(a, b), Q.edit_distance(a, b)
    assert got <= plain or plain > 2
    if got <= 2 and got < plain:  # only a transposition makes it less
        assert sorted(a) != sorted(set(a)) or set(a) & set(b)
    assert Q.edit_distance("ab", "ba") == 1 and Q.edit_distance("abcd", "badc") == 2


def test_slop_is_the_least_total_of_moves(spark):
    rows = []
    for k in range(200):
        r = random.Random(k)
        ps = [sorted(r.sample(range(20), r.randint(1, 4))) for _ in range(r.randint(2, 4))]
        want = min(max(c - k for k, c in enumerate(x)) - min(c - k for k, c in enumerate(x)) for x in itertools.product(*ps))
        rows.append((ps, want))
    df = spark.createDataFrame(rows, "ps array<array<int>>, want int")
    for slop in (0, 1, 3, 6):
        assert df.where(Q._near(F.col("ps"), slop) != (F.col("want") <= slop)).count() == 0


def test_fragments():
    text = "a fox & a dog. " + "x " * 100 + "the fox ran"
    marked = lambda t, word, **o: Q.fragments(t, [(w, w == word) for w in re.findall(r"\w+", t)], **o)
    assert marked(text, "fox", size=20) == [marked(text, "fox", size=20)[0]]
    assert "<b>fox</b> &amp; a" in marked(text, "fox", size=30)[0]
    assert len(marked(text, "fox", size=20, count=2)) == 2
    assert marked(text, "cat", no_match=5) == ["a fox"] and marked("", "cat") == []


def test_highlight_marks_what_the_analyzer_matches(spark):
    df = spark.createDataFrame([("A Café & the running fox.",), (None,)], "t string")
    got = lambda terms, a: df.select(Q.highlight(F.col("t"), terms, a, size=60).alias("h")).collect()
    assert [r.h for r in got(["cafe"], "folding")] == ["A <b>Café</b> &amp; the running fox.", ""]
    assert got(["run"], "english")[0].h == "A Café &amp; the <b>running</b> fox."
    assert got(["fox"], "standard")[0].h == "A Café &amp; the running <b>fox</b>."


def test_query_string():
    assert isinstance(Q.query_string("a b", ["t"]), Q.Or)
    assert isinstance(Q.query_string("+a b", ["t"]), Q.Boosted)
    assert isinstance(Q.query_string('t:"a b"', ["t"]), Q.MatchPhrase)
    assert isinstance(Q.query_string("n:[1 TO 5}"), Q.Range) and Q.query_string("n:[1 TO 5}").high_open
    assert isinstance(Q.query_string("(a OR b) AND c", ["t"]), Q.And)


def test_inverted_lists_recall(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    index = V.InvertedLists.build(df.unionByName(df.limit(1).selectExpr("-1L AS vec_id", "array(1f) AS embedding", "0 AS label")), "embedding", str(tmp_path / "lists"), 8)
    assert spark.read.parquet(str(tmp_path / "lists")).count() == df.count() + 1
    hits = 0
    for r in df.where("vec_id % 5 = 0").collect()[:12]:
        q = [float(x) for x in r.embedding]
        want = {x.vec_id for x in V.nearest(df, "embedding", q, 10, "vec_id").collect()}
        hits += len(want & {x.vec_id for x in index.search("embedding", q, 10, "vec_id").collect()})
        every = [x.vec_id for x in index.search("embedding", q, 10, "vec_id", 8).collect()]
        assert set(every) == want and index.search("embedding", q, 90, "vec_id", 1).count() == min(90, df.count())
    assert hits >= 0.9 * 120


def test_geo_index_scan_equals_a_filter(spark, tmp_path):
    r = random.Random(3)
    df = spark.createDataFrame([(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(600)], "id int, lat double, lon double")
    index = G.indexed(df, "lat", "lon", str(tmp_path / "geo"))
    for box in ((-20.0, 150.0, 30.0, -170.0), (0.0, 0.0, 10.0, 10.0), (-90.0, -180.0, 90.0, 180.0)):
        want = {x.id for x in df.where(G.geo_bbox(F.col("lat"), F.col("lon"), *box)).collect()}
        assert {x.id for x in G.scan(index, "lat", "lon", box).collect()} == want
    assert "GreaterThanOrEqual(_z" in G.scan(index, "lat", "lon", (0.0, 0.0, 10.0, 10.0))._jdf.queryExecution().toString()



def test_embedder():
    v = V.hash_embed("The the fox", 8)
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6) and V.hash_embed("THE, the; Fox!", 8) == v and V.hash_embed("", 4) == [0.0] * 4


@settings(max_examples=60, deadline=None)
@given(st.floats(-80, 80), st.floats(-179, 179), st.floats(1, 2e6), st.floats(0, 1), st.floats(0, 2 * math.pi))
def test_envelope_holds_the_circle(lat, lon, radius, part, angle):
    d = radius * part / G.EARTH_M
    la = math.asin(max(-1, min(1, math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(angle))))
    lo = math.radians(lon) + math.atan2(math.sin(angle) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(la))
    la, lo = math.degrees(la), (math.degrees(lo) + 540) % 360 - 180
    a, w, b, e = G.envelope(lat, lon, radius)
    assert a - 1e-6 <= la <= b + 1e-6 and (w - 1e-6 <= lo <= e + 1e-6 if w <= e else lo >= w - 1e-6 or lo <= e + 1e-6)


def test_morton_cover(spark):
    box = (10.0, 20.0, 30.0, 45.0)
    ranges = G.cover(box)
    assert 1 <= len(ranges) <= 32 and all(a <= b for a, b in ranges)
    r = random.Random(1)
    points = [(r.uniform(10, 30), r.uniform(20, 45)) for _ in range(50)]
    got = spark.createDataFrame(points, "lat double, lon double").select(G.morton(F.col("lat"), F.col("lon")).alias("z")).collect()
    assert all(any(a <= (x.z & (2**64 - 1)) <= b for a, b in ranges) for x in got)


def test_morton_codes_name_a_point_once(spark):
    """Spreading by masks and shifts named each coordinate 32 times, and was evaluated as often within a lambda."""
    points = [(-90.0, -180.0), (90.0, 180.0), (10.25, 20.5), (-33.9, 151.2), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lat double, lon double").select("*", G.morton(F.col("lat"), F.col("lon")).alias("z"), G.covered(F.col("lat"), F.col("lon"), (10.0, 20.0, 30.0, 45.0)).alias("near"))
    for r in df.collect():
        y, x = (math.floor((v - low) / (high - low) * (2**32 - 1) + 0.5) for v, low, high in ((r.lat, -90, 90), (r.lon, -180, 180)))
        want = sum((y >> i & 1) << 2 * i | (x >> i & 1) << 2 * i + 1 for i in range(32))
        assert r.z % 2**64 == want and r.near == any(a <= want <= b for a, b in G.cover((10.0, 20.0, 30.0, 45.0)))
    assert str(G.morton(F.col("lat"), F.col("lon"))).count("lat") == 1


def test_approximate_counts_keep_no_sketch_per_value(spark):
    plan = registry.QUERIES["ag4_approx_count_distinct"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    sketches = [x for x in plan.splitlines() if "approx_count_distinct" in x]
    assert sketches and not any(re.search(r"keys=\[[^\]]*l_partkey", x) for x in sketches)


def test_byte_distance_is_that_of_sql(con):
    r = random.Random(5)
    words = ["tehm", "techß", "teö,", "teßö", "ca", "abc", "é", "e", ""] + ["".join(r.choice("abtehmöß") for _ in range(r.randrange(7))) for _ in range(60)]
    for a, b, d in con.sql(f"SELECT a, b, damerau_levenshtein(a, b) FROM (SELECT unnest({words}) AS a), (SELECT unnest({words}) AS b)").fetchall():
        assert Q.byte_distance(a, b) == min(d, 3), (a, b)


def test_fuzzy_counts_as_it_is_told_to(spark):
    ix = Q.Index(spark.createDataFrame([(1, "techß"), (2, "then"), (3, "teß.")], "id int, t string"), "id", [Q.TextField("t", "whitespace | lowercase")])
    found = lambda q: sorted(r.id for r in Q.search(ix, q).collect())
    assert found(Q.fuzzy("t", "tehm", 2)) == [1, 2, 3] and found(Q.fuzzy("t", "tehm", 2, Q.byte_distance)) == [2]


def test_samples_that_arrive_at_once_are_ordered_by_key(spark):
    from larkspur.operators import timeseries as TS

    rows = spark.createDataFrame([(k, "a", 5, 1000 * (k if k < 2 else 5 - k)) for k in range(4)], "id int, s string, arrived int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    for df in (rows.orderBy("id"), rows.orderBy(F.desc("id"))):
        got = TS.accepted(df.coalesce(1), ["s"], "ts", ["arrived", "id"], 500).collect()
        assert {r.id: r.accepted for r in got} == {0: True, 1: True, 2: True, 3: False}


def test_saving_an_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Postings by runs equal those by groups: with short runs, a second field, a copy, empty texts and keys that repeat."""
    monkeypatch.setattr(Q, "RUN_TOKENS", 50)
    rows = [(k, " ".join(f"w{k * j % 11}" for j in range(k % 9)), None if k % 4 else "ä b") for k in range(80)]
    fields = [Q.TextField("t", "whitespace | lowercase", copy_to="every"), Q.TextField("u", "standard")]
    for more in ([], [(3, "w1 w99 w1", "b"), (None, "w1", None)]):
        docs = spark.createDataFrame(rows + more, "id int, t string, u string").repartition(3)
        plain = Q.Index(docs, "id", fields)
        want = plain.postings.drop("length") if more else plain.postings
        seen = []
        monkeypatch.setattr(type(docs), "repartition", lambda self, *a, f=type(docs).repartition: seen.append(a) or f(self, *a))
        got = Q.Index(docs, "id", fields).saved(str(tmp_path / f"ix{len(more)}"))
        monkeypatch.undo()
        monkeypatch.setattr(Q, "RUN_TOKENS", 50)
        assert bool(seen) == bool(more)
        cells = lambda df: sorted(map(repr, df.collect()))
        assert cells(want) == cells(got.postings.select(*want.columns))


def test_languages_share_their_words(spark):
    df = spark.createDataFrame([("The Dog's naïve-été 42 running chevaux Häuser",), (None,), ("",), ("les nations magnifiques",)], "t string")
    languages = ("french", "german", "english")
    shared = Q.analyzed(df, "t", {x: x for x in languages}).select(*languages)
    assert shared.collect() == df.select(*(Q.analyze(x, F.col("t")).alias(x) for x in languages)).collect()
    assert shared._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
