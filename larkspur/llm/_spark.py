"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that pass between Spark and a Python worker at once: texts may be long, and workers share an executor.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches down to BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made up only in local mode, where the session names none."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return shared_dir.own


_open = threading.local()


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one; an open workspace() removes it when it ends."""
    path = f"{shared_dir(spark)}/larkspur/{what}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None):
        _open.paths[-1].append(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes at its end what durable() and new_path() made within, but for what was written by the function it gives."""
    paths = _open.paths = getattr(_open, "paths", None) or []
    paths.append([])

    def keep(df: DataFrame, what: str, most: int | None = None) -> DataFrame:
        mine = paths.pop()
        try:
            return durable(df, what, most=most)
        finally:
            paths.append(mine)

    try:
        yield keep
    finally:
        for path in paths.pop():
            remove(spark, path)


#: A plain local file system starts a process to set each file's mode, and writes a checksum file beside each; the
#: first cannot be helped, the second can.
WRITING = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a few numbers that make a file.
FILE_ROWS = 50_000


def durable(df: DataFrame, what: str, codec: str = "zstd", most: int | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: later stages survive the loss of any executor.

    Shuffle files of the finished part are released at once, so the disk held is that of the largest part. most: about
    how many rows it may have, if that is known, by which small results are written as few files.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    if most is not None:
        df = df.coalesce(max(2, -(-most // FILE_ROWS)))
    df.write.options(**WRITING).option("compression", codec).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


_caches: dict[str, list[Callable[[], None]]] = {}


def cached(owner: str, size: int) -> Callable[[Callable], Callable]:
    """An lru_cache of a worker's that lasts from task to task, until a function of another owner runs there."""

    def wrap(f: Callable) -> Callable:
        out = functools.lru_cache(size)(f)
        _caches.setdefault(owner, []).append(out.cache_clear)
        return out

    return wrap


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass


def input_parts(df: DataFrame, file_bytes: int = 8 << 20) -> DataFrame:
    """A scan's many small partitions as fewer of about file_bytes of input; what is larger stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))) if size < 1 << 50 else df


def lean(run: Callable, owner: str = "") -> Callable:
    """`run`, a function for mapInArrow, in a worker that drops other owners' caches and returns what it freed to the
    system: workers are reused by later stages and share an executor's memory with others."""

    @functools.wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stale = [clear for other, clears in _caches.items() if other != owner for clear in clears]
        for clear in stale:
            clear()
        if stale:
            _trim()
        yield from run(batches)
        _trim()

    return trimmed


RELEASE_S = 2.0


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more; parts that took no time left none worth it."""
    now = time.monotonic()
    if now - getattr(release, "last", 0.0) < RELEASE_S:
        return
    release.last = now
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n longs that a hash partitioning into n deals to n different partitions: number k to partition k."""
    rows = spark.range(16 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # n rows
    by = {r.p: r.id for r in rows}
    return [by.get(k, -1 - k) for k in range(n)]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """Only the id and the text, under the names that operators use; other columns may be named anything.

    With row, all other columns too, in one struct `row`.
    """
    small_batches(docs.sparkSession)
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")] if row else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *rest)


def restored(rows: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns that `documents(row=True)` took apart, with the text as it is now."""
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns))


def local_path(path: str) -> str | None:
    """A plain path if workers can open `path` themselves."""
    if path.startswith("file:"):
        return "/" + path.split(":", 1)[1].lstrip("/")
    return path if path.startswith("/") else None


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()


def scratch() -> str:
    """A folder in the task's own temporary space, for one task's external sorting; the caller removes it."""
    return tempfile.mkdtemp(prefix="larkspur-", dir=os.environ.get("TMPDIR") or None)
