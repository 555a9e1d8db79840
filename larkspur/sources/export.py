"""Writers: newline-delimited JSON or CSV with the statements that declare the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = {"none": "uncompressed", "lz4": "lz4", "brotli": "brotli", "zstd": "zstd", "snappy": "snappy"}


def ndjson(df: DataFrame, path: str) -> None:
    """A document a line; NULLs are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def csv(df: DataFrame, path: str) -> None:
    """With a header; nested values as JSON."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def declaration(name: str, pk: Sequence[str] = (), series: Sequence[str] = ()) -> str:
    return f"CREATE TIMESERIES TABLE {name} SERIES KEY ({', '.join(series)});" if series else f"CREATE TABLE {name} (PRIMARY KEY ({', '.join(pk)}));"


def tables(engine, path: str, kind: str = "json") -> None:
    """All tables of an engine under `path`, and schema.sql."""
    write = {"json": ndjson, "csv": csv}[kind]
    lines = []
    for key, t in sorted(engine.tables.items()):
        lines.append(declaration(key, t.pk, t.series))
        if t.rows.columns:
            write(t.rows.drop("_written_at"), f"{path}/{key}")
    engine.spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/schema.sql")


def parquet(df: DataFrame, path: str, codec: str = "zstd", sort: Sequence[str] = ()) -> None:
    """Sorted within files by key, so that key slices skip row groups."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").option("compression", CODECS[codec]).parquet(path)
