"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._spark import durable, table
from larkspur.llm.decontaminate import remove_contaminated
from larkspur.llm.jaccard_join import keep_one
from larkspur.llm.language_id import keep_known
from larkspur.llm.mixing import mix
from larkspur.llm.suffix_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the rows with a `lang` teach."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 80 % Jaccard similarity of five-word shingles join, that of least doc_id."""
    return keep_one(docs, words=5, percent=80)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the bytes of strings of 200 bytes that start at two places or more."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Language ID and byte-wise repeats are not expressible; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
