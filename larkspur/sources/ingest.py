"""Readers of what clients send: JSON documents, bulk NDJSON, metrics as text, remote-write messages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BULK = "file string, seq long, action string, table string, id string, doc string"


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One document a line; types are those seen, or the schema's."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def bulk(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Actions of _bulk bodies (a file each): index and create with a document, delete without.

    Bodies follow one another by path, actions by line (seq). An action without an _id gets one of its own, made from
    its body's path and its line, so that a task that runs again makes the same. A body is one request and is read
    whole; its size is bounded by what a server accepts.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for file, body in zip(part["file"], part["value"], strict=True):
                lines = ((k, x) for k, x in enumerate(body.split("\n")) if x.strip())
                for k, line in lines:
                    action, meta = next(iter(json.loads(line).items()))
                    if action not in ("index", "create", "delete"):
                        raise ValueError(f"no bulk action {action!r}")
                    doc = None if action == "delete" else next(lines, (0, None))[1]
                    if doc is None and action != "delete":
                        raise ValueError("an action lacks its document")
                    key = meta.get("_id")
                    if key is None:
                        if action == "delete":
                            raise ValueError("delete takes an _id")
                        key = hashlib.sha256(f"{file}\n{k}".encode()).hexdigest()[:20]
                    out.append((file, k, action, meta.get("_index") or table, str(key), doc))
            yield pd.DataFrame(out, columns=["file", "seq", "action", "table", "id", "doc"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(read, BULK)


def apply_bulk(old: DataFrame, actions: DataFrame, pk: str, schema: str) -> DataFrame:
    """A table after its bulk actions, each id's in order (by `file`, if there is one, and seq).

    `index` writes its document, `delete` removes it, and `create` writes only if the id has none at that moment:
    after an id's last index or delete, the first create counts, if that left none.
    """
    order = F.struct("file", "seq") if "file" in actions.columns else F.struct("seq")
    rows = actions.select("id", "action", "doc", order.alias("at"))
    firm = F.when(F.col("action") != "create", F.col("at"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("action", "doc"), firm).alias("a"), F.max(firm).alias("since"))
    made = rows.where("action = 'create'").join(last.select("id", "since"), "id").where("since is null or at > since").groupBy("id").agg(F.min_by("doc", "at").alias("made"))
    kind = old.schema[pk].dataType
    last = last.join(made, "id", "left").select(F.col("id").cast(kind).alias("_key"), "a.action", "a.doc", "made")
    # what stands after the last index or delete: a document, none, or (without either) what the table had
    sure = last.select("_key", F.when(F.col("action") == "index", F.col("doc")).when(F.col("action") == "delete", F.col("made")).alias("doc"), F.col("action").isNotNull().alias("sure"), "made")
    new = sure.where("sure").select("_key", "doc").unionAll(sure.where("not sure").join(old.select(F.col(pk).alias("_key")), "_key", "left_anti").select("_key", F.col("made").alias("doc")))
    gone = new.select(F.col("_key").alias(pk))
    docs = new.where("doc is not null").select("_key", F.from_json("doc", schema).alias("d"))
    docs = docs.select(*(F.col("_key").alias(c) if c == pk else F.col(f"d.`{c}`") for c in old.columns))
    return old.join(gone, pk, "left_anti").select(old.columns).unionByName(docs)


_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
_LABEL = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'


def exposition(df: DataFrame, now_ms: int, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines of the text exposition format as samples (labels map, ts, value); comments and junk are skipped."""
    c = F.col(column)
    rows = df.where(c.rlike(_LINE)).select(*keep, *(F.regexp_extract(c, _LINE, k).alias(f"_{k}") for k in (1, 2, 3, 4)))
    names, values = (F.regexp_extract_all("_2", F.lit(_LABEL), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r'\\"', '"'), r"\\\\", r"\\"))
    labels = F.map_concat(F.create_map(F.lit("__name__"), F.col("_1")), F.map_from_arrays(names, plain))
    number = F.when(F.col("_3").isin("+Inf", "Inf"), F.lit(float("inf"))).when(F.col("_3") == "-Inf", F.lit(float("-inf"))).otherwise(F.col("_3").try_cast("double"))
    return rows.select(*keep, labels.alias("labels"), F.coalesce(F.col("_4").try_cast("long"), F.lit(now_ms)).alias("ts"), number.alias("value")).where("value is not null")


def scrape(spark: SparkSession, job: str, bodies: dict[str, str | None], now_ms: int) -> DataFrame:
    """One tick over targets: the samples of each body with `instance` and `job`, and `up` (1, or 0 where there is no body).

    bodies: what each target answered, by its instance; a tick's targets are few and their answers small.
    """
    lines = [(target, line) for target, body in bodies.items() for line in (body or "").splitlines()]
    rows = spark.createDataFrame(lines, "instance string, value string")
    own = exposition(rows, now_ms, keep=("instance",))
    up = spark.createDataFrame([(target, 0.0 if body is None else 1.0) for target, body in bodies.items()], "instance string, value double")
    up = up.select("instance", F.create_map(F.lit("__name__"), F.lit("up")).alias("labels"), F.lit(now_ms).cast("long").alias("ts"), "value")
    every = own.select("instance", "labels", F.col("ts").cast("long").alias("ts"), "value").unionAll(up)
    clash = F.map_filter("labels", lambda k, v: ~k.isin("instance", "job"))
    return every.select(F.map_concat(clash, F.create_map(F.lit("instance"), F.col("instance"), F.lit("job"), F.lit(job))).alias("labels"), "ts", "value")


# --- remote write ------------------------------------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints of varints, bytes of the others."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def decode_write(body: bytes) -> Iterator[tuple[dict[str, str], int, float]]:
    """Samples of a remote-write message: a snappy block of WriteRequest{1: TimeSeries{1: Label, 2: Sample}}."""
    import struct

    size, _ = _varint(body, 0)
    raw = pa.Codec("snappy").decompress(body, size).to_pybytes() if size else b""
    for n, series in fields(raw):
        if n != 1:
            continue
        labels, samples = {}, []
        for k, v in fields(series):
            if k == 1:
                pair = dict(fields(v))
                labels[pair[1].decode()] = pair.get(2, b"").decode()
            elif k == 2:
                one = dict(fields(v))
                ts = one.get(2, 0)
                samples.append((ts - (1 << 64) if ts >> 63 else ts, struct.unpack("<d", one.get(1, b"\0" * 8))[0]))
        if "name" in labels:
            labels["exported_name"] = labels.pop("name")
        if "__name__" in labels:
            labels["name"] = labels.pop("__name__")
        for ts, value in samples:
            yield labels, ts, value


def encode_write(samples: Iterable[tuple[dict[str, str], int, float]]) -> bytes:
    """A remote-write message of these samples, a series each."""
    import struct

    def varint(n: int) -> bytes:
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def part(number: int, body: bytes) -> bytes:
        return bytes([number << 3 | 2]) + varint(len(body)) + body

    raw = b""
    for labels, ts, value in samples:
        series = b"".join(part(1, part(1, k.encode()) + part(2, v.encode())) for k, v in sorted(labels.items()))
        raw += part(1, series + part(2, b"\x09" + struct.pack("<d", value) + b"\x10" + varint(ts & (1 << 64) - 1)))
    return pa.Codec("snappy").compress(raw).to_pybytes()


def remote_write(spark: SparkSession, path: str) -> DataFrame:
    """Samples (labels, ts, value) of remote-write bodies, one file each."""
    return decoded_writes(spark.read.format("binaryFile").load(path).select("content"))


def decoded_writes(bodies: DataFrame) -> DataFrame:
    """Samples (labels, ts, value) of the messages in the column `content`."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(list(labels.items()), ts, value) for body in part["content"] for labels, ts, value in decode_write(bytes(body))]
            yield pd.DataFrame(rows, columns=["labels", "ts", "value"])

    got = bodies.select("content").mapInPandas(read, "labels array<struct<k: string, v: string>>, ts long, value double")
    return got.withColumn("labels", F.map_from_entries("labels"))
