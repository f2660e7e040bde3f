"""Law tests for chunking and budget sampling (plain-Python models of the sampling loop)."""

import random

from pyspark.sql import functions as F

from topicweave.operators import sampling as S
from topicweave.sources import fixtures as FX


def _carry_loop(needs, ns):
    """The sampling loop: short sources pass their remainder to the next source."""
    takes, carry = [], 0
    for need, n in zip(needs, ns):
        want = need + carry
        if n <= want:
            takes.append(n)
            carry = want - n
        else:
            takes.append(want)
            carry = 0
    return takes


def test_carry_closed_form_equals_loop(spark):
    rng = random.Random(7)
    cases = []
    for c in range(200):
        ns = [rng.randint(0, 50) for _ in range(4)]
        totals = [n * rng.randint(1, 5) for n in ns]
        target = rng.randint(0, 400)
        ratios = [rng.random() for _ in range(4)]
        cases.append((c, ns, totals, target, ratios))
    rows_t, rows_s = [], []
    for c, ns, totals, target, ratios in cases:
        for i, src in enumerate(S.SOURCES):
            rows_t.append((c, src, totals[i], ns[i]))
            rows_s.append((c, i + 1, src, ratios[i]))
    totals_df = spark.createDataFrame(rows_t, "case int, category string, total_tokens long, n_chunks long")
    spec_df = spark.createDataFrame(rows_s, "case int, ord int, category string, ratio double")
    got = {}
    for c, ns, totals, target, ratios in cases[:20]:
        q = S.sampling_quotas(totals_df.where(F.col("case") == c).drop("case"), spec_df.where(F.col("case") == c).drop("case"), [target])
        got[c] = [r["take"] for r in q.orderBy("ord").collect()]
    for c, ns, totals, target, ratios in cases[:20]:
        needs = [int(int(r * target) / t * n) if t > 0 else 0 for r, t, n in zip(ratios, totals, ns)]
        assert got[c] == _carry_loop(needs, ns), c


def test_chunks_rejoin_to_text(spark, sf_small):
    corpus = FX.corpus(FX.table(spark, sf_small, "documents"))
    chunks = S.chunk_tokens(corpus, 64)
    joined = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"]), "").alias("t"))
    bad = joined.join(corpus, "doc_id").where(F.col("t") != F.col("text")).count()
    assert bad == 0
    last = chunks.groupBy("doc_id").agg(F.max("chunk_no").alias("m"))
    short = chunks.join(last, "doc_id").where((F.col("chunk_no") < F.col("m")) & (F.col("effective_tokens") != 64)).count()
    assert short == 0


def test_chunk_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, " a b"), (4, "x " * 64)], "doc_id long, text string").withColumn("category", F.lit("web"))
    out = {(r["doc_id"], r["chunk_no"]): (r["text"], r["effective_tokens"]) for r in S.chunk_tokens(df, 2).collect()}
    assert (1, 0) not in out
    assert out[(2, 0)] == ("a", 1)
    assert out[(3, 0)] == (" a b", 2)
    assert sum(1 for k in out if k[0] == 4) == 33  # 64 words + trailing space piece -> 65 pieces


def test_nested_and_exact_sample(spark, sf_small):
    corpus = FX.corpus(FX.table(spark, sf_small, "documents"))
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    keys = S.chunk_keys(corpus, 64)
    quotas = S.sampling_quotas(S.source_token_totals(keys), spec, [5000, 20000, 40000])
    out = S.sample_by_budget(corpus, spec, [5000, 20000, 40000], 64, bucket_digits=2)
    counts = {(r["target"], r["category"]): r["n"] for r in out.groupBy("target", "category").agg(F.count("*").alias("n")).collect()}
    for q in quotas.collect():
        assert counts.get((q["target"], q["category"]), 0) == q["take"]
    small = {(r["doc_id"], r["chunk_no"]) for r in out.where("target = 5000").collect()}
    big = {(r["doc_id"], r["chunk_no"]) for r in out.where("target = 40000").collect()}
    assert small <= big


def test_two_phase_equals_full_rank(spark, sf_small):
    corpus = FX.corpus(FX.table(spark, sf_small, "documents"))
    spec = S.parse_ratio_spec(spark, FX.FIXTURE_RATIOS)
    keys = S.chunk_keys(corpus, 64)
    quotas = S.sampling_quotas(S.source_token_totals(keys), spec, [20000])
    from pyspark.sql import Window

    ranked = keys.withColumn("k", F.md5(F.concat_ws(":", F.lit("42"), "doc_id", "chunk_no"))).withColumn(
        "rn", F.row_number().over(Window.partitionBy("category").orderBy("k", "doc_id", "chunk_no")))
    full = {(r["doc_id"], r["chunk_no"]) for r in ranked.join(quotas, "category").where("rn <= take").collect()}
    two = {(r["doc_id"], r["chunk_no"]) for r in S.sample_by_budget(corpus, spec, [20000], 64, bucket_digits=1).collect()}
    assert full == two
