"""Corpus chunking and exact token-budget sampling by source ratio.

Plan shape at scale:

* ``chunk_tokens`` is a narrow map (regex + posexplode); no shuffle.
* ``source_token_totals`` is one partial+final aggregate per category.
* ``sampling_quotas`` works on (#targets x #sources) rows.
* ``sample_chunks`` picks exactly ``take`` chunks per (target, source) in md5 order
  without ranking a whole source in one task: chunk keys are counted per md5-prefix
  bucket, the running sum over the (small) bucket table finds the cut bucket, only rows
  of the cut bucket are ranked, and the result is a threshold key per (target, source).
  The final pass is a filter against that threshold (broadcast of #targets x #sources
  rows), so chunk text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicweave.functions.hashing import md5_key
from topicweave.functions.tokens import chunk_arrays, chunk_starts, token_pieces

# The source order of the quota carry-over loop, and the default ratios,
# targets and chunk length of the sampling job.
SOURCES = ("books", "code", "ref", "web")
DEFAULT_RATIOS = "books:0.002,code:0.138,ref:0.025,web:0.835"
DEFAULT_TARGETS = (2600000000, 7200000000, 15600000000, 30000000000)
DEFAULT_CHUNK_LEN = 1024
DEFAULT_SEED = "42"


def chunk_tokens(corpus: DataFrame, chunk_len: int = DEFAULT_CHUNK_LEN, keep: Sequence[str] = ("doc_id", "category")) -> DataFrame:
    """ST1: 1->N map of each text to chunks of ``chunk_len`` pieces (last one short).

    Output: keep..., chunk_no INT, text STRING, effective_tokens INT. Empty text gives no row.
    """
    pieces = corpus.select(*keep, token_pieces(F.col("text")).alias("_pieces"))
    exploded = pieces.select(*keep, F.posexplode(chunk_arrays(F.col("_pieces"), chunk_len)).alias("chunk_no", "_chunk"))
    return exploded.select(
        *keep,
        F.col("chunk_no").cast("int").alias("chunk_no"),
        F.array_join("_chunk", "").alias("text"),
        F.size("_chunk").cast("int").alias("effective_tokens"),
    )


def chunk_keys(corpus: DataFrame, chunk_len: int = DEFAULT_CHUNK_LEN, keep: Sequence[str] = ("doc_id", "category")) -> DataFrame:
    """Chunk identities and sizes without materialising chunk text (for counting passes)."""
    n = corpus.select(*keep, F.size(token_pieces(F.col("text"))).alias("_n"))
    starts = n.select(*keep, "_n", F.posexplode(chunk_starts(F.col("_n"), chunk_len)).alias("chunk_no", "_start"))
    return starts.select(
        *keep,
        F.col("chunk_no").cast("int").alias("chunk_no"),
        F.least(F.lit(chunk_len), F.col("_n") - F.col("_start")).cast("int").alias("effective_tokens"),
    )


def token_recount(chunks: DataFrame) -> DataFrame:
    """ST2: recount the pieces of each chunk's text (may differ from effective_tokens after decode)."""
    return chunks.withColumn("tokens", F.size(token_pieces(F.col("text"))).cast("int"))


def source_token_totals(chunks: DataFrame) -> DataFrame:
    """AG1: per-source token sum and chunk count, computed once for all targets."""
    return chunks.groupBy("category").agg(
        F.sum("effective_tokens").cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("n_chunks"),
    )


def parse_ratio_spec(spark: SparkSession, spec: str = DEFAULT_RATIOS, sources: Sequence[str] = SOURCES) -> DataFrame:
    """PF7: ``"books:0.002,code:0.138,..."`` -> (ord, category, ratio).

    ``ord`` is the position in ``sources`` (the carry-over order), not in the spec string.
    """
    order = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("ord", "category")).select(
        (F.col("ord") + 1).cast("int").alias("ord"), "category"
    )
    parsed = spark.range(1).select(
        F.explode(F.str_to_map(F.lit(spec), F.lit(","), F.lit(":"))).alias("category", "_ratio")
    ).select(F.trim("category").alias("category"), F.trim("_ratio").cast("double").alias("ratio"))
    return order.join(parsed, "category", "left").select("ord", "category", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def sampling_quotas(totals: DataFrame, spec: DataFrame, targets: Sequence[int], percent: bool = False) -> DataFrame:
    """SO5 + WN1: chunks to take per (target, source) with carry-over to the next source.

    need  = floor(floor(ratio * target) / total_tokens * n_chunks)  (0 when a source is empty)
    carry = running Lindley recursion c_k = max(0, c_{k-1} + need_k - n_k), in closed form
            X_k - min(0, min_{j<=k} X_j) with X_k = sum_{j<=k} (need_j - n_j)
    take  = least(n_k, need_k + c_{k-1})
    The remainder after the last source is lost, and every target starts from zero.
    With ``percent`` the targets are percentages of the tokens of the spec's sources, so budgets
    grow with the corpus; equal targets count once. Works on #targets x #sources rows only.
    """
    t = (
        spec.join(totals, "category", "left")
        .select(
            "ord", "category", "ratio",
            F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        )
    )
    budgets = [F.lit(int(x)).cast("long") for x in targets]
    if percent:
        t = t.withColumn("_all", F.sum("total_tokens").over(Window.partitionBy()))  # one row per source
        budgets = [F.floor(F.col("_all") * x / 100) for x in budgets]
    t = t.withColumn("target", F.explode(F.array_distinct(F.array(*budgets)))).drop("_all")
    quota = F.floor(F.col("ratio") * F.col("target"))
    need = F.when(F.col("total_tokens") > 0, F.floor(quota / F.col("total_tokens") * F.col("n_chunks"))).otherwise(F.lit(0))
    t = t.withColumn("quota_tokens", quota.cast("long")).withColumn("need", need.cast("long"))
    w = Window.partitionBy("target").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = F.sum(F.col("need") - F.col("n_chunks")).over(w)
    t = t.withColumn("_x", x).withColumn("carry", F.col("_x") - F.least(F.lit(0), F.min("_x").over(w)))
    prev = F.coalesce(F.lag("carry", 1).over(Window.partitionBy("target").orderBy("ord")), F.lit(0))
    t = t.withColumn("take", F.least(F.col("n_chunks"), F.col("need") + prev).cast("long"))
    return t.select("target", "ord", "category", "ratio", "total_tokens", "n_chunks", "quota_tokens", "need", "carry", "take")


def _sample_key(seed: str) -> Column:
    return md5_key(seed, F.col("doc_id"), F.col("chunk_no"))


def sample_thresholds(keys: DataFrame, quotas: DataFrame, seed: str = DEFAULT_SEED, bucket_digits: int = 4) -> DataFrame:
    """Per (target, category): the (key, doc_id, chunk_no) of the ``take``-th chunk in md5 order.

    Two-phase exact selection; no task sees more than one md5 bucket of one source.
    """
    k = keys.select("category", "doc_id", "chunk_no").withColumn("_key", _sample_key(seed))
    k = k.withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    counts = k.groupBy("category", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("category").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_incl", F.sum("_n").over(w)).withColumn("_before", F.col("_incl") - F.col("_n"))
    # one row per category with the (few) takes attached: each take matches exactly one bucket
    takes = quotas.where(F.col("take") > 0).groupBy("category").agg(
        F.collect_list(F.struct("target", "take")).alias("_takes")
    )
    cuts = cum.join(takes, "category").select(
        "category", "_bucket", "_before",
        F.explode(F.filter("_takes", lambda t: (F.col("_before") < t["take"]) & (t["take"] <= F.col("_incl")))).alias("_t"),
    ).select("category", "_bucket", F.col("_t.target").alias("target"), (F.col("_t.take") - F.col("_before")).alias("_rem"))
    # rank only the rows of the cut buckets
    in_cut = k.join(cuts.select("category", "_bucket").distinct(), ["category", "_bucket"], "left_semi")
    rw = Window.partitionBy("category", "_bucket").orderBy("_key", "doc_id", "chunk_no")
    ranked = in_cut.withColumn("_rn", F.row_number().over(rw))
    return ranked.join(cuts, ["category", "_bucket"]).where(F.col("_rn") == F.col("_rem")).select(
        "target", "category", F.struct("_key", "doc_id", "chunk_no").alias("threshold")
    )


def sample_chunks(chunks: DataFrame, thresholds: DataFrame, seed: str = DEFAULT_SEED) -> DataFrame:
    """SO3/SO4: every chunk whose (key, doc_id, chunk_no) is at or below its source's threshold.

    One md5 order for all targets, so a smaller target's sample is contained in a larger one's.
    The threshold table has #targets x #sources rows; it is attached per category as an array.
    """
    per_cat = thresholds.groupBy("category").agg(F.collect_list(F.struct("target", "threshold")).alias("_th"))
    c = chunks.withColumn("_key", _sample_key(seed)).join(F.broadcast(per_cat), "category")
    me = F.struct(F.col("_key"), F.col("doc_id"), F.col("chunk_no"))
    picked = c.withColumn("target", F.explode(F.transform(F.filter("_th", lambda t: me <= t["threshold"]), lambda t: t["target"])))
    return picked.drop("_th", "_key")


def sample_by_budget(
    corpus: DataFrame,
    spec: DataFrame,
    targets: Sequence[int],
    chunk_len: int = DEFAULT_CHUNK_LEN,
    seed: str = DEFAULT_SEED,
    bucket_digits: int = 4,
    percent: bool = False,
) -> DataFrame:
    """The sampling job: chunk, total per source, quotas with carry-over, exact nested sample.

    Returns (target, category, doc_id, chunk_no, text, effective_tokens). Runs the key pass
    eagerly (it writes the chunk-key and the quota table); the returned frame is the lazy second pass.
    """
    from topicweave.sources.io import materialize

    # Pass 1 over the text: chunk identities and sizes only (one small row per chunk), written
    # once to the shared folder; totals, quotas, bucket counts and the cut-bucket ranking all
    # read this table. Pass 2 chunks the text and filters it against the thresholds.
    keys = materialize(chunk_keys(corpus, chunk_len), "chunk-keys")
    quotas = materialize(sampling_quotas(source_token_totals(keys), spec, targets, percent), "quotas")
    th = sample_thresholds(keys, quotas, seed, bucket_digits)
    chunks = chunk_tokens(corpus, chunk_len)
    return sample_chunks(chunks, th, seed).select("target", "category", "doc_id", "chunk_no", "text", "effective_tokens")


def sampled_token_totals(sample: DataFrame, distinct_docs: bool = False) -> DataFrame:
    """AG2: tokens per target after sampling, recounted from the chunk text.

    With ``distinct_docs`` the same aggregate also counts distinct source documents (n_docs),
    so the sample (and the chunk pass over the text under it) is computed once.
    """
    aggs = [
        F.sum(F.size(token_pieces(F.col("text")))).cast("long").alias("tokens"),
        F.sum("effective_tokens").cast("long").alias("effective_tokens"),
        F.count(F.lit(1)).alias("n_chunks"),
    ]
    if distinct_docs:
        aggs.append(F.countDistinct("doc_id").alias("n_docs"))
    return sample.groupBy("target").agg(*aggs)


def write_sample(sample: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """SK2: one output directory per target in a single pass."""
    # No repartition by (target, category) first: that would leave a handful of tasks (one per
    # pair, the largest source holding most rows) writing the whole sample. Each task writes its
    # own file per target instead; maxRecordsPerFile bounds file sizes.
    sample.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).partitionBy("target").parquet(path)


def peek_rows(df: DataFrame, key_cols: Sequence[str], k: int = 5, seed: str = DEFAULT_SEED) -> DataFrame:
    """SO7: ``k`` rows in seeded md5 order (a top-k over the whole table)."""
    key = md5_key(seed, *[F.col(c) for c in key_cols])
    return df.withColumn("_peek", key).orderBy("_peek", *key_cols).limit(k).drop("_peek")
