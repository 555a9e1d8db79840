"""Time-series tables: one row per (series labels, ts) with numeric fields.

The rate family is two-level: changes within a series by `lag`, sums per (group, series), then sums over the
series of a group. Changes from one bucket into the next do not count, as the group is part of the window.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.scalar import duration, time_bucket


def matcher(label: str, op: str, value: str) -> Column:
    """A label matcher; a missing label reads as ''. Patterns match whole values."""
    c = F.coalesce(F.col(label).cast("string"), F.lit(""))
    if op == "=":
        return c == value
    if op == "!=":
        return c != value
    hit = c.rlike(f"^(?:{value})\\z")
    return {"=~": hit, "!~": ~hit}[op]


def scan(df: DataFrame, matchers: Sequence[tuple[str, str, str]] = (), t0: object = None, t1: object = None, ts: str = "ts") -> DataFrame:
    """Samples of the series that match, within [t0, t1]."""
    for m in matchers:
        df = df.where(matcher(*m))
    if t0 is not None:
        df = df.where(F.col(ts) >= F.lit(t0))
    if t1 is not None:
        df = df.where(F.col(ts) <= F.lit(t1))
    return df


def series_of(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.select(*labels).distinct()


def bucketed(df: DataFrame, step: str | int, ts: str = "ts", out: str = "bucket") -> DataFrame:
    return df.withColumn(out, time_bucket(step, F.col(ts), df.schema[ts].dataType))


def rates(df: DataFrame, series: Sequence[str], group: Sequence[str], field: str, ts: str = "ts") -> DataFrame:
    """rate, increase and delta per group: increase counts a drop as a reset to zero; a series needs two samples
    (and a span above zero for a rate); nothing is extrapolated."""
    ms = F.unix_micros(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName() != "bigint" and df.schema[ts].dataType.typeName() != "long" else F.col(ts).cast("long") * 1000
    keys = list(dict.fromkeys([*group, *series]))
    w = W.partitionBy(*keys).orderBy("_us")
    rows = df.where(F.col(field).isNotNull()).select(*keys, ms.alias("_us"), F.col(field).cast("double").alias("_v"))
    prev = F.lag("_v").over(w)
    rows = rows.withColumn("_inc", F.when(prev.isNotNull(), F.when(F.col("_v") >= prev, F.col("_v") - prev).otherwise(F.col("_v"))))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_inc").alias("_i"), ((F.max("_us") - F.min("_us")) / 1e6).alias("_span"), (F.max_by("_v", "_us") - F.min_by("_v", "_us")).alias("_d")).where("_n >= 2")
    return per.groupBy(*group).agg(F.sum(F.when(F.col("_span") > 0, F.try_divide("_i", "_span"))).alias("rate"), F.sum("_i").alias("increase"), F.sum("_d").alias("delta"))


def first_value(field: str, ts: str = "ts") -> Column:
    return F.min_by(field, F.when(F.col(field).isNotNull(), F.col(ts)))


def last_value(field: str, ts: str = "ts") -> Column:
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.col(ts)))


# --- rollups -----------------------------------------------------------------------------------------------


def rollup(df: DataFrame, labels: Sequence[str], fields: Sequence[str], step: str | int, ts: str = "ts") -> DataFrame:
    """Per bucket and series the partials <field>_{count,sum,min,max,first,last}."""
    made = []
    for f in fields:
        made += [F.count(f).alias(f"{f}_count"), F.sum(f).alias(f"{f}_sum"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), first_value(f, ts).alias(f"{f}_first"), last_value(f, ts).alias(f"{f}_last")]
    return bucketed(df, step, ts).groupBy(*labels, "bucket").agg(*made)


def reroll(partials: DataFrame, labels: Sequence[str], field: str, step: str | int) -> DataFrame:
    """Partials of a coarser step from finer ones; the coarse step is a multiple of the fine."""
    rows = bucketed(partials, step, "bucket", "_to")
    f = field
    out = rows.groupBy(*labels, F.col("_to").alias("bucket")).agg(
        F.sum(f"{f}_count").alias(f"{f}_count"), F.sum(f"{f}_sum").alias(f"{f}_sum"), F.min(f"{f}_min").alias(f"{f}_min"), F.max(f"{f}_max").alias(f"{f}_max"),
        F.min_by(f"{f}_first", "bucket").alias(f"{f}_first"), F.max_by(f"{f}_last", "bucket").alias(f"{f}_last"),
    )
    return out


def stitched(aged: DataFrame, raw: DataFrame, split: Column, labels: Sequence[str], field: str, step: str | int, ts: str = "ts") -> DataFrame:
    """Buckets before `split` from a rollup, those from it on from raw samples."""
    old = reroll(aged.where(F.col("bucket") < split), labels, field, step)
    new = rollup(raw.where(F.col(ts) >= split), labels, [field], step, ts)
    return old.unionByName(new)


# --- late and repeated samples -----------------------------------------------------------------------------


def accepted(df: DataFrame, series: Sequence[str], ts: str, arrival: str | Sequence[str], ooo: str | int) -> DataFrame:
    """Adds `accepted`: a sample that arrives later than newer ones counts if it is newer than the newest so far
    less the out-of-order window; one at the newest time itself is rejected. Where several can arrive at once,
    `arrival` names a key too: without it their order, and so the answer, would be left open."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    newest = F.max(ms).over(W.partitionBy(*series).orderBy(*([arrival] if isinstance(arrival, str) else arrival)).rowsBetween(W.unboundedPreceding, -1))
    ok = newest.isNull() | (ms > newest) | ((ms < newest) & (ms > newest - duration(ooo)))
    return df.withColumn("accepted", ok)


def last_write(df: DataFrame, series: Sequence[str], ts: str, field: str, arrival: str) -> DataFrame:
    """One value per (series, ts): that which arrived last."""
    return df.groupBy(*series, ts).agg(F.max_by(field, arrival).alias(field))


def retained(df: DataFrame, keep: str | int, ts: str = "ts") -> DataFrame:
    """Samples not older than the newest less `keep`."""
    newest = df.agg(F.max(F.unix_millis(F.col(ts).cast("timestamp"))).alias("_newest"))  # one row
    return df.crossJoin(F.broadcast(newest)).where(F.unix_millis(F.col(ts).cast("timestamp")) >= F.col("_newest") - duration(keep)).drop("_newest")


def validate(columns: dict[str, str], labels: Sequence[str]) -> None:
    """A time-series row needs its string labels, ts, and a numeric field; names that begin with __ are taken."""
    missing = [c for c in [*labels, "ts"] if c not in columns]
    if missing:
        raise ValueError(f"missing {missing}")
    if bad := [c for c in labels if columns[c] != "string"]:
        raise ValueError(f"labels are strings: {bad}")
    if bad := [c for c in columns if c.startswith("__")]:
        raise ValueError(f"reserved names: {bad}")
    fields = [c for c in columns if c not in labels and c != "ts"]
    if not fields or any(not re.match("tinyint|smallint|int|bigint|float|double|decimal", columns[c]) for c in fields):
        raise ValueError("at least one field, and only numeric ones")
