"""Registered queries for corpus chunking and token-budget sampling (ST1 ST2 AG1 AG2 PF7 SO3-SO8 WN1)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from topicweave.functions.hashing import md5_key
from topicweave.operators import sampling as S
from topicweave.plans import sql as Q
from topicweave.sources import fixtures as FX

L = FX.FIXTURE_CHUNK_LEN
BUDGET = 75  # percent of the corpus's tokens


def _corpus(spark, sf):
    return FX.corpus(FX.table(spark, sf, "documents"))


def q_chunk_tokens(spark: SparkSession, sf: str):
    return S.chunk_tokens(_corpus(spark, sf), L)


def q_token_recount(spark, sf):
    chunks = S.token_recount(S.chunk_tokens(_corpus(spark, sf), L))
    return chunks.groupBy("category").agg(
        F.sum("tokens").cast("long").alias("recounted_tokens"),
        F.sum("effective_tokens").cast("long").alias("effective_tokens"),
        F.sum(F.when(F.col("tokens") != F.col("effective_tokens"), 1).otherwise(0)).cast("long").alias("n_differ"),
    )


def q_source_token_totals(spark, sf):
    return S.source_token_totals(S.chunk_keys(_corpus(spark, sf), L))


def q_parse_ratio_spec(spark, sf):
    """PF7: the parsed spec in carry-over order with each source's chunk count."""
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    totals = S.source_token_totals(S.chunk_keys(_corpus(spark, sf), L))
    return spec.join(totals, "category", "left").select("ord", "category", "ratio", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def q_sampling_quota_carry(spark, sf):
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    totals = S.source_token_totals(S.chunk_keys(_corpus(spark, sf), L))
    return S.sampling_quotas(totals, spec, FX.FIXTURE_TARGETS, percent=True)


def q_sample_by_budget(spark, sf):
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    out = S.sample_by_budget(_corpus(spark, sf), spec, [BUDGET], L, percent=True)
    return out.select("target", "category", "doc_id", "chunk_no", "effective_tokens")


def q_sample_nested_targets(spark, sf):
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    out = S.sample_by_budget(_corpus(spark, sf), spec, FX.FIXTURE_TARGETS, L, percent=True)
    return S.sampled_token_totals(out, distinct_docs=True)


def q_peek_rows(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return S.peek_rows(docs, ["doc_id"], k=5)


def q_first_n_rows(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.orderBy("doc_id").limit(25)


def q_shard_assign(spark, sf):
    docs = FX.table(spark, sf, "documents")
    return docs.select("doc_id", F.pmod("doc_id", F.lit(8)).cast("int").alias("shard"), "n_chars").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").cast("long").alias("n_chars"), F.min("doc_id").alias("first_doc")
    )


def q_blank_filter(spark, sf):
    from topicweave.functions.text import is_non_blank

    docs = FX.table(spark, sf, "documents")
    return docs.where(is_non_blank(F.col("text"))).select("doc_id", "lang")


def entry_query(spark, sf):
    """Flagship: the exact nested token-budget sample with chunk text."""
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    return S.sample_by_budget(_corpus(spark, sf), spec, FX.FIXTURE_TARGETS, L, percent=True)


QUERIES = {
    "chunk_tokens": q_chunk_tokens,
    "token_recount": q_token_recount,
    "source_token_totals": q_source_token_totals,
    "parse_ratio_spec": q_parse_ratio_spec,
    "sampling_quota_carry": q_sampling_quota_carry,
    "sample_by_budget": q_sample_by_budget,
    "sample_nested_targets": q_sample_nested_targets,
    "peek_rows": q_peek_rows,
    "first_n_rows": q_first_n_rows,
    "shard_assign": q_shard_assign,
    "blank_filter": q_blank_filter,
}

_BASE = f"WITH {Q.CORPUS},\n{Q.chunks_cte(L)}"
_SPEC = Q.spec_cte(FX.FIXTURE_RATIOS)
_RANKED = f"""ranked AS (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY category ORDER BY {Q.md5key("'42'", 'doc_id', 'chunk_no')}, doc_id, chunk_no) AS rn
  FROM chunks c)"""

ORACLE = {
    "chunk_tokens": _BASE + "\nSELECT doc_id, category, chunk_no, text, effective_tokens FROM chunks",
    "token_recount": _BASE + f"""
SELECT category,
       CAST(SUM(len(regexp_extract_all(text, {Q.TOK_SQL}))) AS BIGINT) AS recounted_tokens,
       CAST(SUM(effective_tokens) AS BIGINT) AS effective_tokens,
       CAST(SUM(CASE WHEN len(regexp_extract_all(text, {Q.TOK_SQL})) <> effective_tokens THEN 1 ELSE 0 END) AS BIGINT) AS n_differ
FROM chunks GROUP BY category""",
    "source_token_totals": _BASE + """
SELECT category, CAST(SUM(effective_tokens) AS BIGINT) AS total_tokens, COUNT(*) AS n_chunks FROM chunks GROUP BY category""",
    "sampling_quota_carry": _BASE + f",\n{_SPEC},\n{Q.quotas_cte(FX.FIXTURE_TARGETS)}\nSELECT * FROM quotas",
    "parse_ratio_spec": _BASE + f",\n{_SPEC}" + """,
tot AS (SELECT category, COUNT(*) AS n_chunks FROM chunks GROUP BY category)
SELECT s.ord, s.category, s.ratio, coalesce(t.n_chunks, 0) AS n_chunks FROM spec s LEFT JOIN tot t ON t.category = s.category""",
    "sample_by_budget": _BASE + f",\n{_SPEC},\n{Q.quotas_cte([BUDGET])},\n{_RANKED}" + """
SELECT q.target, r.category, r.doc_id, r.chunk_no, r.effective_tokens
FROM ranked r JOIN quotas q ON r.category = q.category WHERE r.rn <= q.take""",
    "sample_nested_targets": _BASE + f",\n{_SPEC},\n{Q.quotas_cte(FX.FIXTURE_TARGETS)},\n{_RANKED}" + f""",
picked AS (
  SELECT q.target, r.* FROM ranked r JOIN quotas q ON r.category = q.category WHERE r.rn <= q.take)
SELECT target,
       CAST(SUM(len(regexp_extract_all(text, {Q.TOK_SQL}))) AS BIGINT) AS tokens,
       CAST(SUM(effective_tokens) AS BIGINT) AS effective_tokens,
       COUNT(*) AS n_chunks,
       COUNT(DISTINCT doc_id) AS n_docs
FROM picked GROUP BY target""",
    "peek_rows": f"""
SELECT doc_id, lang, source, n_chars FROM documents
ORDER BY {Q.md5key("'42'", 'doc_id')}, doc_id LIMIT 5""",
    "first_n_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25",
    "shard_assign": """
SELECT CAST(doc_id % 8 AS INTEGER) AS shard, COUNT(*) AS n_rows, CAST(SUM(n_chars) AS BIGINT) AS n_chars, MIN(doc_id) AS first_doc
FROM documents GROUP BY 1""",
    "blank_filter": r"""
SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}]')""",
}
