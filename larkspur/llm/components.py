"""Connected components of an edge table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import durable, workspace


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (its least id) of every node of `edges` (a, b longs).

    Each round links a node's greater neighbours to its least one, then its lesser neighbours; the
    forest becomes stars in a number of rounds that grows with the logarithm of the longest path. Hot nodes
    only ever meet in grouped minima and joins, which Spark combines and splits.
    """
    with workspace(edges.sparkSession) as keep:
        n = edges.count()
        pairs = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", most=n)
        state = None
        for _ in range(most):
            both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            small_least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small_least.select("u", F.col("m").alias("v")))
            pairs = durable(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", most=2 * n)
            got = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)).alias("s")).first()
            if (got.n, got.s) == state:
                return keep(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(pairs.select("v", "v").distinct()), "components", 2 * got.n)
            state = got.n, got.s
    raise RuntimeError(f"no fixed point after {most} rounds")
