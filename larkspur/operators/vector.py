"""Nearest neighbours, hybrid ranking and reranking.

Distances are built-in array expressions, so a search is a projection and a top-k, both distributed. Filters
come before the top-k, which makes filtered searches exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, vector: Column, query: Sequence[float]) -> Column:
    """cosine: 1 - cos; l2: squared; dot: negated. NULL for vectors of another length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "cosine":
        norm = F.sqrt(_dot(vector, vector)) * float(np.sqrt(np.dot(query, query)))
        d = 1 - F.when(norm > 0, F.try_divide(_dot(vector, q), norm)).otherwise(F.lit(0.0))
    elif metric == "l2":
        d = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    elif metric == "dot":
        d = -_dot(vector, q)
    else:
        raise ValueError(f"no metric {metric!r}")
    return F.when(F.size(vector) == len(query), d)


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, pk: str, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k rows nearest to `query` with `_distance`, nearest first."""
    if where is not None:
        df = df.where(where)
    return df.withColumn("_distance", distance(metric, F.col(vector), query)).where("_distance is not null").orderBy(F.col("_distance").asc(), F.col(pk).asc()).limit(k)


def quantize(vector: Column) -> Column:
    """int8 with one scale per vector: struct(scale, values)."""
    scale = F.greatest(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))) / 127.0, F.lit(1e-12))
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("values"))


def nearest_quantized(df: DataFrame, vector: str, query: Sequence[float], k: int, pk: str, metric: str = "cosine", oversample: int = 4) -> DataFrame:
    """Coarse search over int8 vectors, then exact distances of oversample * k candidates."""
    coarse = df.withColumn("_q", quantize(F.col(vector)))
    coarse = coarse.withColumn("_coarse", F.transform("_q.values", lambda x: x.cast("double") * F.col("_q.scale")))
    candidates = coarse.withColumn("_c", distance(metric, F.col("_coarse"), query)).orderBy(F.col("_c").asc_nulls_last(), F.col(pk).asc()).limit(k * oversample)
    return nearest(candidates.drop("_q", "_coarse", "_c"), vector, query, k, pk, metric)


@dataclass
class InvertedLists:
    """An approximate index: every row stands in the list of its nearest centroid, in a folder of its own.

    Centroids come from k-means over a sample of at most SAMPLE_PER_LIST vectors a list; all rows are indexed. A search
    reads the folders of the nearest lists only, and more of them if they hold fewer than k rows, so it always gives
    k rows where there are k. With as many probes as lists it is exact.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    metric: str

    SAMPLE_PER_LIST = 64

    @classmethod
    def build(cls, df: DataFrame, vector: str, path: str, lists: int = 16, metric: str = "cosine", seed: int = 7) -> InvertedLists:
        rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        want = lists * cls.SAMPLE_PER_LIST
        sample = rows.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(want).collect()  # at most `want` vectors
        dim = Counter(len(r.v) for r in sample).most_common(1)[0][0] if sample else 0  # the usual length
        centroids = _kmeans(np.array([r.v for r in sample if len(r.v) == dim], float), lists, metric, seed) if sample else np.zeros((0, 0))
        shared = df.sparkSession.sparkContext.broadcast(centroids)

        @F.pandas_udf("int")
        def nearest_list(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                same = s.map(lambda v: len(v) == shared.value.shape[1])
                out = np.full(len(s), -1, np.int32)  # vectors of another length are in no search
                if same.any():
                    out[same.to_numpy()] = _closest(np.stack(s[same].to_numpy()).astype(float), shared.value, metric)
                yield pd.Series(out)

        rows.withColumn("_list", nearest_list(vector)).repartition("_list").write.mode("overwrite").partitionBy("_list").parquet(path)
        return cls(df.sparkSession, path, centroids, metric)

    def search(self, vector: str, query: Sequence[float], k: int, pk: str, probes: int | None = None) -> DataFrame:
        """The k rows found nearest, with `_distance`. Without probes, three lists of four: enough for nine of ten
        neighbours of vectors that hardly cluster; of vectors that do, far fewer are."""
        probes = probes or -(-3 * len(self.centroids) // 4)
        rows = self.spark.read.parquet(self.path)
        order = np.argsort(_distances(np.array([query], float), self.centroids, self.metric)[0]).tolist()
        while True:
            near = rows.where(F.col("_list").isin(order[:probes]))
            if probes >= len(order) or near.limit(k).count() >= k:
                return nearest(near.drop("_list"), vector, query, k, pk, self.metric)
            probes *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _distances(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return -_unit(x) @ _unit(centroids).T
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None] if metric == "l2" else -x @ centroids.T


def _closest(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    return _distances(x, centroids, metric).argmin(1).astype(np.int32)


def _kmeans(x: np.ndarray, lists: int, metric: str, seed: int, rounds: int = 10) -> np.ndarray:
    x = _unit(x) if metric == "cosine" else x
    centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        at = _closest(x, centroids, metric)
        centroids = np.stack([x[at == k].mean(0) if (at == k).any() else centroids[k] for k in range(len(centroids))])
    return centroids


# --- embedding ---------------------------------------------------------------------------------------------

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def words(text: str) -> list[str]:
    """Alphanumeric runs, with A-Z lower."""
    clean = "".join(c if c.isalnum() else " " for c in text)
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in clean.split()]


def hash_embed(text: str | None, dim: int) -> list[float]:
    """Bag of hashed words with unit length; the same text always has the same vector."""
    v = np.zeros(dim, np.float32)
    for w in words(text or ""):
        h = FNV_OFFSET
        for b in w.encode():
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        v[h % dim] += 1
    norm = np.sqrt((v * v).sum(dtype=np.float32))
    return (v / norm if norm > 0 else v).tolist()


def embedded(df: DataFrame, text: str, out: str, dim: int, embedder: Callable[[str | None], list[float]] | None = None) -> DataFrame:
    """Adds a vector column made from a text column, by hash_embed or a given function."""
    make = embedder or (lambda t: hash_embed(t, dim))

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: make(t))

    return df.withColumn(out, embed(F.col(text)))


# --- hybrid ------------------------------------------------------------------------------------------------


def rrf(legs: Sequence[DataFrame], pk: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion. legs: at most a few hundred rows each with pk and `_rank` (from 1)."""
    parts = [leg.select(pk, (1.0 / (F.lit(c) + F.col("_rank"))).alias("_part")) for leg in legs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    fused = every.groupBy(pk).agg(F.sum("_part").alias("_rrf_score"))
    return fused.orderBy(F.col("_rrf_score").desc(), F.col(pk).asc()).limit(k)


def ranked(df: DataFrame, by: Column, pk: str, k: int) -> DataFrame:
    """The k first rows with their `_rank`; ranks are given after the cut, over k rows."""
    top = df.orderBy(by, F.col(pk).asc()).limit(k)
    return top.withColumn("_rank", F.row_number().over(W.orderBy(by, F.col(pk).asc())))


def overlap(text: Column, query: str) -> Column:
    """The share of the query's different words that a text has."""
    q = sorted(set(words(query)))
    if not q:
        return F.lit(0.0)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    have = F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return F.coalesce(F.size(F.array_intersect(have, F.array(*map(F.lit, q)))), F.lit(0)) / F.lit(float(len(q)))


def rerank(df: DataFrame, by: Column, pk: str, text: str, query: str, n: int = 100, k: int = 10, score: Callable[[Column, str], Column] = overlap) -> DataFrame:
    """Reorders the first n rows by a second score (at most 1000 of them)."""
    if not 1 <= n <= 1000:
        raise ValueError("rerank takes 1 to 1000 rows")
    first = ranked(df, by, pk, n)
    return first.withColumn("_rerank", score(F.col(text), query)).orderBy(F.col("_rerank").desc(), F.col("_rank").asc()).limit(k)
