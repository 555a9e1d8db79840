"""Relational operators with the engine's conventions: NULL order, tie-breaks, top-k per group, keyset paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordering(*keys: tuple[Column | str, str]) -> list[Column]:
    """Sort columns: NULLs last when ascending, first when descending."""
    out = []
    for key, way in keys:
        c = F.col(key) if isinstance(key, str) else key
        out.append(c.asc_nulls_last() if way.lower() == "asc" else c.desc_nulls_first())
    return out


def order_by(df: DataFrame, *keys: tuple[Column | str, str], pk: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with the primary key as last tie-break, LIMIT and OFFSET: one top-k pass if a limit is given."""
    named = {k for k, _ in keys if isinstance(k, str)}
    df = df.orderBy(*ordering(*keys), *(F.col(p).asc() for p in pk if p not in named))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def top_k_per_group(df: DataFrame, group: Sequence[str], by: Column | str, k: int, way: str = "desc", pk: Sequence[str] = ()) -> DataFrame:
    """GROUP BY ... TOP k BY: the k first rows of each group; NULLs rank last either way."""
    c = F.col(by) if isinstance(by, str) else by
    first = c.asc_nulls_last() if way.lower() == "asc" else c.desc_nulls_last()
    rank = F.row_number().over(W.partitionBy(*group).orderBy(first, *(F.col(p).asc() for p in pk)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def join(left: DataFrame, right: DataFrame, on: Column | None, how: str = "inner", left_name: str = "l", right_name: str = "r") -> DataFrame:
    """INNER, LEFT, RIGHT or CROSS join with any condition; of columns named alike the left one stays."""
    a, b = left.alias(left_name), right.alias(right_name)
    joined = a.crossJoin(b) if on is None else a.join(b, on, how)
    names = [F.col(f"{left_name}.`{c}`") for c in left.columns]
    names += [F.col(f"{right_name}.`{c}`") for c in right.columns if c not in left.columns]
    return joined.select(*names)


def union(*parts: DataFrame, distinct: bool = True) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct() if distinct else out


def keyset_after(df: DataFrame, key: str, way: str, pk: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after (sort value, primary key); the primary key always ascends."""
    if after is not None:
        value, last = after
        beyond = F.col(key) > F.lit(value) if way == "asc" else F.col(key) < F.lit(value)
        df = df.where(beyond | ((F.col(key) == F.lit(value)) & (F.col(pk) > F.lit(last))))
    return order_by(df.where(F.col(key).isNotNull()), (key, way), pk=[pk], limit=limit)


def percentile(c: Column, p: float) -> Column:
    """Interpolated percentile; p counts in ten-thousandths."""
    if not 0 < p <= 1:
        raise ValueError("percentile needs 0 < p <= 1")
    return F.percentile(c, round(p, 4))


# --- DML on immutable frames -------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows of `new` replace rows of equal key; of new rows with one key the last by `_seq`, if there is one, stays."""
    if "_seq" in new.columns:
        last = F.row_number().over(W.partitionBy(*pk).orderBy(F.col("_seq").desc()))
        new = new.withColumn("_last", last).where("_last = 1").drop("_last", "_seq")
    return old.join(new.select(*pk), list(pk), "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """SET path = value for rows where the predicate is true; a dotted path sets a field of a document."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    columns = {}
    for path, value in sets.items():
        root, _, rest = path.partition(".")
        now = columns.get(root, F.col(root) if root in df.columns else F.lit(None))
        columns[root] = F.when(hit, now.withField(rest, value) if rest else value).otherwise(now)
    return df.withColumns(columns)


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the predicate is false or NULL stay."""
    return df.where(F.lit(False)) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def with_ttl(df: DataFrame, written_at: str, ttl_ms: int, now: Column) -> DataFrame:
    """Rows still visible: written less than ttl ago."""
    return df.where(F.unix_millis(F.col(written_at).cast("timestamp")) > F.unix_millis(now) - ttl_ms)


def latest_fields(df: DataFrame, pk: Sequence[str], fields: Sequence[str], clock: str) -> DataFrame:
    """Field-level last write wins: of each field the value of the greatest clock at which it was set."""
    return df.groupBy(*pk).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(clock))).alias(f) for f in fields))


def describe_types(df: DataFrame) -> DataFrame:
    """DESCRIBE FULL: each field, the types seen in it and how many rows have it."""
    aggregates = [F.count(c).alias(c) for c in df.columns]
    counted = df.agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(t).alias("types"), F.col(f"`{c}`").alias("present")) for c, t in df.dtypes))
    return counted.select(F.explode(rows).alias("r")).select("r.*")
