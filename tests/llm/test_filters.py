"""Decontamination, mixing, chat format and the pipeline."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import chat_format, decontaminate, language_id, mixing, queries
from larkspur.llm.mixing import mix, mix_plan


def test_decontamination(spark, docs, nothing, monkeypatch):
    items = [(1, "Alpha beta, gamma! delta epsilon zeta eta theta iota"), (2, "one two"), (3, None), (4, "..."), (2, "one two"), (5, "zeta eta theta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x ALPHA-beta gamma delta EPSILON zeta eta theta y one Two z"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, None), (4, ""), (5, "zeta, eta: theta"), (6, "one\ntwo one two"), (6, "one\ntwo one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS items")
    want = {(1, 13, ((1, 9), (10, 12)), ("1", "2", "5")), (2, 7, (), ()), (3, 0, (), ()), (4, 0, (), ()), (5, 3, ((0, 3),), ("5",)), (6, 4, ((0, 4),), ("2",))}
    read = lambda f: {(r.doc_id, r.n_words, tuple(map(tuple, r.ranges)), tuple(r["items"])) for r in f.collect()}
    assert read(decontaminate.find_contamination(df, bench)) == want
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 6]
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(df, bench, "spans").collect()}
    assert cut[1] == "x  y  z" and cut[2] == rows[1][1] and cut[5] == ""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)  # several broadcast blocks
    several = decontaminate.find_contamination(df, bench)
    assert read(several) == want and several.count() == len(rows)
    maps = decontaminate.remove_contaminated(df.selectExpr("*", "map('k', doc_id) AS more"), bench)  # a column that cannot be grouped by
    assert sorted(r.more["k"] for r in maps.collect()) == [2, 3, 4, 5, 6, 6]
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert all(not r["items"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_mixing(spark, docs, nothing):
    got = mix_plan(docs).toPandas()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("copies", "max"))
    total = got["size"].sum()
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all() and (by.most <= 2).all()
    assert ((by.taken - by.target).abs() <= 2 * got.groupby("source", dropna=False)["size"].max()).all()
    again = mix_plan(docs.repartition(3)).toPandas()
    assert got.sort_values(["doc_id"]).taken.tolist() == again.sort_values(["doc_id"]).taken.tolist()
    rows = mix(docs)
    assert rows.columns == docs.columns and rows.count() == got.copies.sum()
    assert mix_plan(nothing).count() == 0 and mix(nothing).count() == 0
    none = mix_plan(spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert len(none) == 3 and all(r.taken == 0 and r.target == 0 for r in none)


def test_gram_set_is_a_few_times_its_text():
    import pickle
    import random

    r = random.Random(4)
    items = [(str(k), " ".join("%05x" % r.randrange(16**5) for _ in range(200)).encode()) for k in range(400)]
    size = sum(len(t) for _, t in items)
    got = decontaminate.GramSet(items, 8)
    assert len(pickle.dumps(got)) - len(got.filter) < 5 * size
    assert got.lengths == [8] and len(got.hashes) == 400 * 193


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall(), got.select(*want.columns).schema).collect())


@pytest.mark.parametrize("block", [2, 7])
def test_mixing_in_small_blocks_equals_sql(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(k * 37 % 101 if k % 9 else None, "w " * (k % 4 + k % 3 * 7), ("a", "b", None)[k % 5 % 3]) for k in range(180)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op4_source_mixing"])
    got = queries.op4_source_mixing(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall(), got.schema).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert mix(docs).count() == mix_plan(docs).agg(F.sum("copies")).first()[0]


TEXT = st.lists(st.sampled_from([*"ab\\<>#/ \né", "<turn ", "</turn>", "### ", ">\n", "</turn>\n", "<image 0>", "<audio 12>", "<document ", "1>"]), max_size=30).map("".join)
PART = st.one_of(TEXT, TEXT.map(lambda t: {"type": "text", "text": t}), st.sampled_from([{"type": k, "ref": "r"} for k in chat_format.KINDS]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn x>"]), st.lists(PART, max_size=6)), max_size=4))
def test_parts_round_trip(turns):
    """Against a second reading: what the parts say, with neighbouring texts joined."""
    whole, want, loss = "", [], []
    for role, parts in turns:
        flat = chat_format.PartVisitor().visit(parts)
        formatted, spans = chat_format.format_parts(role, flat)
        plain, k = [], 0
        for p in parts:
            text = p if isinstance(p, str) else p.get("text")
            if text is None:
                plain.append((p["type"], k))
                k += 1
            elif text:
                plain = [*plain[:-1], plain[-1] + text] if plain and isinstance(plain[-1], str) else [*plain, text]
        want.append((role, plain))
        whole += formatted
        got = "".join(chat_format.unescape(formatted[a:b]) for a, b in spans)
        assert got == ("".join(x for x in plain if isinstance(x, str)) if role == "assistant" else "")
    assert chat_format.parse_parts(whole) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_template_round_trip(turns):
    whole = "".join(chat_format.format_turn(role, text)[0] for role, text in turns)
    assert chat_format.parse(whole) == turns


@given(TEXT)
def test_loss_is_the_text(text):
    formatted, ((a, b),) = chat_format.format_turn("assistant", text)
    assert chat_format.unescape(formatted[a:b]) == text and chat_format.format_turn("user", text)[1] == []


def test_parts():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, "and", {"type": "audio", "url": "b.wav", "seconds": 2}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    got = chat_format.PartVisitor().visit(parts)
    assert got.text == "see <image 0>and<audio 1><document 2>"
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)]
    with pytest.raises(ValueError):
        chat_format.PartVisitor().visit([{"type": "video"}])


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi </turn> ok"), (1, 0, "user", "a\\b"), (2, 0, None, None), (1, 2, "assistant", "end"), (1, 2, "assistant", "end"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    turns = "user\na\\b\nassistant\nhi </turn> ok\nassistant\nend\nassistant\nend\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == 19 and got[1].loss_sha256 == hashlib.sha256(b"hi </turn> okendend").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0
    typed = spark.createDataFrame([(1, 0, "user", json.dumps([{"type": "image", "ref": "x"}])), (1, 1, "assistant", json.dumps("yes"))], "conv_id long, turn long, role string, text string")
    forged = spark.createDataFrame([(1, 0, "user", json.dumps(["see <image 0> ", {"type": "image", "ref": "x"}]))], "conv_id long, turn long, role string, text string")
    one = chat_format.format_turns(forged, typed=True).first()
    assert chat_format.parse_parts(one.formatted) == [("user", ["see <image 0> ", ("image", 0)])]
    assert chat_format.read_back(chat_format.format_turns(forged, typed=True)).first().n_attachments == 1
    first = chat_format.format_turns(typed, typed=True).where("turn = 0").first()
    assert "image 0" in first.formatted and first.attachments[0].ref == "x" and first.n_tokens_expanded == 1


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage against a brute-force version on what its predecessor kept."""
    import sys

    sys.path.insert(0, "tests/llm")
    from test_dedup import repeated_bytes
    from test_jaccard import brute

    text = docs.where("doc_id = 4").first().text
    bench = spark.createDataFrame([(1, " ".join(text.split()[:9])), (2, " ".join(text.split()[2:12]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == now.dtypes or name == "mixture"
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = [(r.doc_id, r.text, r.n_chars) for r in now.collect()]
        ids = sorted(d for d, _, _ in after)
        if name == "language":
            # a text without letters goes, and so do hundreds of one letter, which no language has
            assert ids == sorted(d for d, t in before.items() if t and any(c.isalpha() for c in t) and (len(t) < 60 or len(set(t)) > 1))
        elif name == "near_duplicates":
            assert ids == sorted(d for d, (_, c) in brute(before.items()).items() if c == d)
        elif name == "repeated_bytes":
            want = {r[0]: r for r in repeated_bytes(before.items(), 200)}
            assert ids == sorted(before) and all(n == len(t) for _, t, n in after)
            assert all(hashlib.sha256(t.encode()).hexdigest() == want[d][4] or not before[d].isascii() for d, t, _ in after)
        elif name == "decontamination":
            assert set(before) - set(ids) <= {4} and set(ids) <= set(before)
        else:
            plan = {r.doc_id: r.copies for r in mix_plan(spark.read.parquet(str(tmp_path / "decontamination"))).collect()}
            assert all(ids.count(d) == n for d, n in plan.items())
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in ran.collect()) == ids


def test_pipeline_keeps_clean_rows_whatever_their_ids(spark, tmp_path):
    """Null and repeated ids, copies among them, empty texts; and an empty table through all stages."""
    import random

    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b, c, d = (text(120) for _ in range(4))
    rows = [(None, a), (None, b), (3, c), (3, d), (4, c), (None, d), (5, None), (5, ""), (6, text(40)), (6, text(40))]
    docs = spark.createDataFrame([(k, t, "x", "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    bench = spark.createDataFrame([(1, text(12))], "item_id long, text string")
    for name in ("full", "none"):
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert got.columns == docs.columns
    kept = {(x.doc_id, x.text) for x in got.collect()}
    # of copies, the row of the least id stays; the mix may leave out some and take others twice
    clean = {(None, a), (None, b), (3, c), (3, d), *((k, t) for k, t in rows if k == 6)}
    assert kept <= clean and len(kept) >= 4
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {(x.doc_id, x.text) for x in one.collect() if x.text} == clean
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_drops_documents_with_one_whole_item(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, item), (2, "one two three four five six seven eight")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (2, f"x {' '.join(item.split()[:8])}"), (3, f"y {' '.join(item.split()[:7])}"), (4, None)]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_fold_matches_crc32(docs):
    import zlib

    got = docs.select("doc_id", language_id.fold(F.col("doc_id"), 7).alias("k")).collect()
    assert all(r.k == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)
