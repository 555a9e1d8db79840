"""Continuous aggregates and late samples on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.scalar import duration


def rollup_stream(stream: DataFrame, labels: Sequence[str], field: str, step: str, late: str, ts: str = "ts") -> DataFrame:
    """Partials per bucket and series as they change; buckets older than `late` are closed and their state dropped."""
    f = F.col(field)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{duration(late)} milliseconds")
    w = F.window(ts, f"{duration(step)} milliseconds")
    out = rows.groupBy(w.alias("w"), *labels).agg(
        F.count(f).alias(f"{field}_count"), F.sum(f).alias(f"{field}_sum"), F.min(f).alias(f"{field}_min"), F.max(f).alias(f"{field}_max"),
        F.min_by(f, F.when(f.isNotNull(), F.col(ts))).alias(f"{field}_first"), F.max_by(f, F.when(f.isNotNull(), F.col(ts))).alias(f"{field}_last"),
    )
    return out.select(*labels, F.col("w.start").alias("bucket"), *(c for c in out.columns if c.startswith(f"{field}_")))


def upsert_sink(path: str):
    """A foreachBatch function that keeps rows in Parquet under `path`.

    Each batch is written to a folder of its own, named by its number, so a batch that runs again replaces
    itself; `current` reads the newest row of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark, path: str, keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def accept_stream(stream: DataFrame, series: Sequence[str], ts: str, value: str, seq: str, ooo: str) -> DataFrame:
    """Samples with `accepted`, judged per series: newer than the newest so far, or within the out-of-order
    window before it (both ends excluded). The state is one time per series.
    """
    reach = duration(ooo)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (*series, value, seq)}
    out = ", ".join([*(f"{c} {kinds[c]}" for c in series), "ts_ms long", f"{value} {kinds[value]}", f"{seq} {kinds[seq]}", "accepted boolean"])

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values(seq)
            marks = []
            for t in part["ts_ms"]:
                marks.append(newest is None or t > newest or (newest - reach < t < newest))
                newest = t if newest is None else max(newest, t)
            yield part.assign(accepted=marks)[[*series, "ts_ms", value, seq, "accepted"]]
        state.update((int(newest),))

    rows = stream.select(*series, F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"), value, seq)
    return rows.groupBy(*series).applyInPandasWithState(judge, out, "newest long", "append", GroupStateTimeout.NoTimeout)


def refreshed(stream: DataFrame, build, interval: str | None = "1 second"):
    """Near-real-time refresh: every interval `build` gets the rows that came in, to add to an index; without one, what is there now, once."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.trigger(**trigger).foreachBatch(lambda batch, number: build(batch, number))
