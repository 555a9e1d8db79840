"""The queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat_format, crf_quality, decontaminate, edit_fingerprint, kneser_ney, language_id
from larkspur.llm._spark import table
from larkspur.llm.jaccard_join import jaccard_classes
from larkspur.llm.mixing import MIX_SQL, mix_plan
from larkspur.llm.substring_dedup import substring_dedup
from larkspur.llm.suffix_dedup import suffix_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op2_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edit_test(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.learn(docs.where(~held_out), F.col("text"), F.col("lang"))
    found = language_id.identify(docs, F.struct("doc_id", held_out.alias("held_out")), F.col("text"), *model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    n_items = F.size("items").cast("long")
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), items.alias("items_sha256"), (n_items >= decontaminate.MIN_ITEMS).alias("contaminated"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 7) == 2
    model = kneser_ney.train(docs.where(~held_out), F.col("text"))
    found = kneser_ney.score(docs, model, F.struct("doc_id", held_out.alias("held_out")), F.col("text"))
    return found.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    crf = crf_quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = crf_quality.score(docs, crf, F.struct("doc_id", held_out.alias("held_out")), F.col("text"))
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= crf_quality.CUT).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    found = chat_format.read_back(chat_format.format_turns(conversations))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_edit_fingerprint, op3_language_id, op4_source_mixing, op5_jaccard_join, op6_decontamination, op7_kneser_ney, op8_quality_crf, op9_chat_format, op10_suffix_array_dedup, pipeline)
    return {f.__name__: f for f in own}


OP4_SQL = MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OP6_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
gram AS (SELECT DISTINCT item, least(len(w), 8) AS m, array_to_string(w[p : p + least(len(w), 8) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS t(p) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT m FROM gram) AS k, unnest(range(1, len(w) - m + 2)) AS t(p)),
hit AS (SELECT r, p, m, item FROM spot JOIN gram USING (m, g)),
word AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + m)) AS t(q) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": OP4_SQL, "op6_decontamination": OP6_SQL}
