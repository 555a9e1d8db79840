"""Ingest, export and streaming."""

import json
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.operators import timeseries as TS
from larkspur.sources import export, ingest
from larkspur.streaming import rollups


def test_bulk(spark, tmp_path):
    lines = [{"index": {"_id": 1}}, {"id": 1, "v": 5}, {"create": {"_id": 2}}, {"id": 2, "v": 9}, {"delete": {"_id": 3}}, {"index": {"_id": 1}}, {"id": 1, "v": 6}]
    (tmp_path / "b.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\n")
    old = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "id long, v long")
    got = ingest.apply_bulk(old, ingest.bulk(spark, str(tmp_path)), "id", "id long, v long")
    assert sorted(map(tuple, got.collect())) == [(1, 6), (2, 1), (4, 1)]


def test_bulk_ids_and_order(spark, tmp_path):
    body = lambda *lines: "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n"
    (tmp_path / "1.ndjson").write_text(body({"index": {"_id": "a"}}, {"v": 1}, "", {"index": {}}, {"v": 7}, {"index": {}}, {"v": 8}, {"index": {"_id": "b"}}, {"v": 2}, {"create": {"_id": "b"}}, {"v": 3}))
    (tmp_path / "2.ndjson").write_text(body({"index": {"_id": "a"}}, {"v": 9}, {"delete": {"_id": "c"}}, {"create": {"_id": "c"}}, {"v": 4}, {"create": {"_id": "c"}}, {"v": 5}, {"create": {"_id": "d"}}, {"v": 6}))
    old = spark.createDataFrame([("c", 1), ("d", 1)], "id string, v long")
    acts = ingest.bulk(spark, str(tmp_path), "t")
    got = sorted(map(tuple, ingest.apply_bulk(old, acts, "id", "id string, v long").collect()))
    assert [r for r in got if len(r[0]) == 1] == [("a", 9), ("b", 2), ("c", 4), ("d", 1)]
    made = [r for r in got if len(r[0]) > 1]
    assert sorted(v for _, v in made) == [7, 8] and len({k for k, _ in made}) == 2
    assert sorted(map(tuple, acts.collect())) == sorted(map(tuple, acts.collect()))  # ids are the same again


def test_scrape_and_encoded_writes(spark):
    got = ingest.scrape(spark, "j", {"a": 'x{job="k",z="1"} 2 77', "b": None}, 50).collect()
    assert sorted((r.labels["__name__"], r.labels["instance"], r.ts, r.value) for r in got) == [("up", "a", 50, 1.0), ("up", "b", 50, 0.0), ("x", "a", 77, 2.0)]
    assert all(r.labels["job"] == "j" for r in got)
    samples = [({"host": "é"}, -5, 2.5), ({"host": "b", "k": "v" * 300}, 1 << 40, float("inf"))]
    assert [*ingest.decode_write(ingest.encode_write(samples))] == samples and [*ingest.decode_write(ingest.encode_write([]))] == []


def test_exposition(spark):
    text = ["# HELP x y", 'http_total{code="200",path="/a\\"b"} 3', "up 1 1700000000000", 'b{le="+Inf"} +Inf', "junk line here ok"]
    got = ingest.exposition(spark.createDataFrame([(x,) for x in text], "value string"), 5).collect()
    assert {(r.labels["__name__"], r.ts, r.value) for r in got} == {("http_total", 5, 3.0), ("up", 1700000000000, 1.0), ("b", 5, float("inf"))}
    assert next(r for r in got if r.labels["__name__"] == "http_total").labels["path"] == '/a"b'


def message(n, body):
    size = len(body)
    out = bytes([n << 3 | 2])
    while size >= 0x80:
        out += bytes([size & 0x7F | 0x80])
        size >>= 7
    return out + bytes([size]) + body


def test_remote_write(spark, tmp_path):
    labels = b"".join(message(1, message(1, k) + message(2, v)) for k, v in ((b"__name__", b"cpu"), (b"name", b"n"), (b"host", b"a")))
    sample = bytes([1 << 3 | 1]) + struct.pack("<d", 1.5) + bytes([2 << 3, 100])
    raw = message(1, labels + message(2, sample))
    (tmp_path / "w.bin").write_bytes(pa.Codec("snappy").compress(raw).to_pybytes())
    got = ingest.remote_write(spark, str(tmp_path)).collect()
    assert [(r.labels, r.ts, r.value) for r in got] == [({"name": "cpu", "exported_name": "n", "host": "a"}, 100, 1.5)]


def test_export(spark, tmp_path):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, None, [1, 2]), (2, "x", None)], "id long, s string, a array<long>"), ["id"])
    export.tables(e, str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j" / "t")).collect())
    assert lines == ['{"id":1,"a":[1,2]}', '{"id":2,"s":"x"}']
    export.tables(e, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c" / "t")).columns == ["id", "s", "a"]
    assert spark.read.text(str(tmp_path / "j" / "schema.sql")).first()[0] == "CREATE TABLE t (PRIMARY KEY (id));"


def test_stream_rollup_equals_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 60, 3)] + [("b", "2024-01-01 00:01:00", 2.0)]
    df = spark.createDataFrame(rows, "host string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rollups.rollup_stream(stream, ["host"], "v", "10m", "2h")
    q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(rollups.upsert_sink(str(tmp_path / "out"))).start()
    q.processAllAvailable()
    q.stop()
    got = rollups.current(spark, str(tmp_path / "out"), ["host", "bucket"])
    want = TS.rollup(df, ["host"], ["v"], "10m")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_late_samples_equal_batch(spark, tmp_path):
    times = [10, 20, 15, 20, 9, 40, 31, 30, 41]
    df = spark.createDataFrame([("a", 1000 * t, float(t), k) for k, t in enumerate(times)], "host string, ms long, v double, seq long").withColumn("ts", F.timestamp_millis("ms"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rollups.accept_stream(stream, ["host"], "ts", "v", "seq", "10s").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.seq: r.accepted for r in spark.table("late").collect()}
    want = {r.seq: r.accepted for r in TS.accepted(df, ["host"], "ts", "seq", "10s").collect()}
    assert got == want == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: True}
