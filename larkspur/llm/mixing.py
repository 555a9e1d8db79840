"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of the words to take, cut at a multiple of the source's size; what is
cut is shared anew among the others. Each document then expects target / source size copies: these are
prefix-summed over the source's documents in order of size, one random offset is added, and a copy is emitted
for each integer that the running sum crosses. Documents of like size lie together, so a source's words come
near its target.

Prefix sums over a source are made of block offsets (one row per block) and ranks within blocks. Blocks are
ranges of the order itself: a size class or, of one with more than BLOCK documents, each size or, of one with
more, ranges of ids of about BLOCK documents; so no source meets in one task, and where the cuts lie never
changes a result. Only documents of one size and one id (or none) stay together whatever their number.

Defined results: a null text has size 0; sources are ordered by code point, null last, and null is a source
of its own; a source without words has target 0 and takes nothing; equal rows are separate documents; an
empty table gives an empty result. Other columns pass through `mix` whatever their names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm._spark import durable

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 20240607
#: Copies are counted in this many parts, so that sums are exact whatever their order.
UNIT = 10**8
BLOCK = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def offset(seed: int) -> int:
    return random.Random(seed).randrange(UNIT)


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size and target of each source; sized: source, size.

    With sources in order of cap/weight, the level at which all uncapped sources fill up evenly is the
    largest of (what is left after capping all before) / (weights from here on).
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(cap))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / rest)
    return by.select("source", "source_size", F.least("cap", F.col("w") * F.max("level").over(everything)).alias("target"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys match each other."""
    right = right.select(*(F.col(k).alias(f"{k}_r") if k in keys else F.col(k) for k in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return left.join(right, on).drop(*(f"{k}_r" for k in keys))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, payload: list[Column], weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """id, source, size, source_size, target and copies of each document, with the payload columns."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.col(f"`{id_col}`").cast("long").alias("id"), *payload)
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    if not payload:
        rows = durable(rows, "sizes")  # texts are read once
    counted = durable(rows.groupBy("source", "class", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    of_class = counted.groupBy("source", "class").agg((F.sum("n") > BLOCK).alias("by_size"))
    rows = null_safe_join(rows, of_class, ["source", "class"])
    rows = rows.withColumn("part", F.when(F.col("by_size"), F.col("size")).otherwise(F.lit(0))).drop("by_size")
    most = counted.agg(F.max("n")).first()[0] or 0
    if most > BLOCK:
        parts = -(-most // BLOCK)
        large = counted.where(F.col("n") > BLOCK).select("source", "size")
        cuts = F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))
        cuts = durable(null_safe_join(rows.select("source", "size", "id"), large, ["source", "size"]).groupBy("source", "size").agg(F.array_distinct(cuts).alias("cuts")), "cuts")
        cuts = cuts.select(F.col("source").alias("source_c"), F.col("size").alias("size_c"), "cuts")
        rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("source_c")) & (F.col("size") == F.col("size_c")), "left").drop("source_c", "size_c")
        below = F.size(F.filter("cuts", lambda c: c < F.col("id")))
        block = F.when(F.col("cuts").isNull() | (F.size("cuts") == 0), F.lit(0)).when(F.col("id").isNull(), F.size("cuts") + 1).otherwise(below)
        rows = rows.withColumn("block", block).drop("cuts")
    else:
        rows = rows.withColumn("block", F.lit(0))
    per_block = rows.groupBy("source", "class", "part", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class", "part", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_block = per_block.select("source", "class", "part", "block", ahead.alias("ahead"))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long")
    per_source = targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap).withColumn("step", step)
    per_block = durable(null_safe_join(per_block, per_source, ["source"]), "blocks")
    rank = F.row_number().over(W.partitionBy("source", "class", "part", "block").orderBy("size", F.col("id").asc_nulls_last()))
    rows = null_safe_join(rows.withColumn("rank", rank), per_block, ["source", "class", "part", "block"])
    rows = rows.withColumn("upto", (F.col("ahead") + F.col("rank")) * F.col("step") + F.lit(offset(seed)))
    return rows.withColumn("copies", F.expr(f"(upto div {UNIT}) - ((upto - step) div {UNIT})"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words that the mix takes) of each document."""
    rows = planned(docs, id_col, text_col, source_col, [], weights, share, cap, seed)
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs`, with all its columns, as often as it is taken."""
    rows = planned(docs, id_col, text_col, source_col, [F.struct("*").alias("row")], weights, share, cap, seed)
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns))


#: The same by plain windows over whole sources, for DuckDB; {docs} is the documents' relation.
MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {{docs}}),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS w FROM by_source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM weighed),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM capped),
filled AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
stepped AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {UNIT}) AS BIGINT) ELSE 0 END AS step FROM filled),
ranked AS (SELECT doc_id, s.source, size, source_size, target, step,
  row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS LAST) * step + {offset(SEED)} AS upto
  FROM sized s JOIN stepped t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (upto // {UNIT}) - ((upto - step) // {UNIT}) AS copies FROM ranked)
"""
