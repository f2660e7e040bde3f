"""Registered queries of this package, one per operator, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm import decontaminate, exact_dedup, language, line_rules, lm_score, mixing, phrases, quality, repeats, simhash, token_counts, toxicity, whitening
from topicweave.llm.tables import documents_of, held_out, table_of

TOKENIZER = "byte_bpe_50k.json"
CONTEXT = 1024  # tokens; longer documents are over the limit


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents_of(spark, sf_dir), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents_of(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def _scored(found: DataFrame, threshold: float) -> DataFrame:
    rows = found.withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.toxicity(documents_of(spark, sf_dir), table_of(spark, sf_dir, "labels")), 0.5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents_of(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.quality(documents_of(spark, sf_dir), table_of(spark, sf_dir, "labels")), 0.3)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(documents_of(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.alignments(documents_of(spark, sf_dir), table_of(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "similarity", "first_word", "end_word")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents_of(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_lines(documents_of(spark, sf_dir), with_text=False).withColumnRenamed("id", "doc_id")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return repeats.removal_digest(docs, repeats.repeat_spans(docs, length=400)).withColumnRenamed("id", "doc_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents_of(spark, sf_dir), least=30, top=2000)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table_of(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(documents_of(spark, sf_dir).select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("sha", "text_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_lm_score": op8_lm_score,
    "op9_line_rules": op9_line_rules,
    "op10_suffix_array": op10_suffix_array,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE: dict[str, str] = {"op4_mixing": mixing.MIX_SQL, "op9_line_rules": line_rules.RULES_SQL, "op11_collocations": phrases.COLLOCATIONS_SQL, "op13_exact_dedup": exact_dedup.DEDUP_SQL}
