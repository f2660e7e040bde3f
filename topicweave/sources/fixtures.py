"""Adapters from the given tables to the pipeline's inputs.

Each adapter is a pure DataFrame expression over a given table, so its work grows with the
table. The oracle SQL in ``plans.oracle`` spells the same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions.hashing import hex_int, hex_uniform, md5_key
from topicweave.functions.tokens import token_pieces
from topicweave.operators.sampling import SOURCES
from topicweave.operators.sequences import hashed_id
from topicweave.operators.topics import CATEGORIES, categories_col

FIXTURE_CHUNK_LEN = 64
FIXTURE_RATIOS = "books:0.4,code:0.3,ref:0.2,web:0.1"
FIXTURE_TARGETS = (12, 25, 50, 75)  # percent of the corpus's tokens
FIXTURE_CLUSTERS = 10
SMALL_CLUSTERS = 200          # of a few documents: some have no keyword in the lexicon
LOSS_STEP_SIZE = 32          # samples per step
LOSS_ADJUST_EVERY = 10       # steps per reweighting window
LOSS_SWITCH_AFTER = 200      # stage 1 after this step
ZERO_WINDOW = 3              # a window of zero losses in the hard log
LATE_EVERY = 97              # every so many samples of the hard log's first half come late
MICRO_BATCH = 8              # samples per micro-batch
GRAD_ACCUM = 4               # micro-batches per optimiser step
PAIR_WINDOW = 1024            # tokens of a pair's input
EVAL_BATCH = 16              # docs per evaluation batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as scanned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(documents: DataFrame) -> DataFrame:
    """D1: documents with a source category by ``source`` number mod 4."""
    idx = F.pmod(F.substring("source", 4, 12).cast("int"), F.lit(4))
    cat = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (idx + 1).cast("int"))
    return documents.select("doc_id", "text", cat.alias("category"))


def clustered_text(documents: DataFrame, n_clusters: int = FIXTURE_CLUSTERS) -> DataFrame:
    """D5 with text: cluster = doc_id mod n_clusters."""
    return documents.select("doc_id", "text", F.pmod("doc_id", F.lit(n_clusters)).cast("int").alias("cluster"))


def topic_lexicon(benchmark: DataFrame) -> DataFrame:
    """(keyword, label): the words of the benchmark whose md5 starts with 0, each under a category by its md5."""
    words = benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("keyword")).distinct()
    h = F.md5("keyword")
    return words.where(h < "1").select("keyword", F.element_at(categories_col(), (F.pmod(hex_int(h, 2, 4), F.lit(len(CATEGORIES))) + 1).cast("int")).alias("label"))


def loss_log(events: DataFrame) -> DataFrame:
    """D14: (step, sample_id, labels, loss) from events.

    step = floor(event_id/32)+1, loss = value/100, k = props.k;
    labels: k%10=0 -> []; k%3=0 -> [event_type, 'k'||(k%7)]; else [event_type].
    """
    k = F.get_json_object("props", "$.k").cast("int")
    labels = (
        F.when(F.pmod(k, F.lit(10)) == 0, F.array().cast("array<string>"))
        .when(F.pmod(k, F.lit(3)) == 0, F.array(F.col("event_type"), F.concat(F.lit("k"), F.pmod(k, F.lit(7)).cast("string"))))
        .otherwise(F.array(F.col("event_type")))
    )
    return events.select(
        (F.floor(F.col("event_id") / LOSS_STEP_SIZE) + 1).cast("long").alias("step"),
        F.col("event_id").cast("long").alias("sample_id"),
        labels.alias("labels"),
        (F.col("value") / 100.0).alias("loss"),
    )


def hard_loss_log(events: DataFrame, every: int) -> DataFrame:
    """D14 as a feed with its difficult cases: the last window is full, all losses of window ``ZERO_WINDOW`` are 0, and every
    97th sample of the first half of the windows arrives at the very end. Adds ``arrival``, the order of the feed."""
    log = loss_log(events)
    windows = log.agg(F.floor(F.max("step") / F.lit(float(every))).cast("long")).scalar()
    window = F.ceil(F.col("step") / F.lit(float(every))).cast("long")
    late = (F.pmod("sample_id", F.lit(LATE_EVERY)) == 0) & (2 * window <= windows)
    return log.where(F.col("step") <= windows * every).select(
        "step", "sample_id", "labels", F.when(window == ZERO_WINDOW, F.lit(0.0)).otherwise(F.col("loss")).alias("loss"),
        F.when(late, windows * every).otherwise(F.col("step")).cast("long").alias("arrival"))


def loss_vocabulary(log: DataFrame) -> DataFrame:
    """D12 for the loss log: distinct labels plus 'never' (a label no window sees)."""
    seen = log.select(F.explode("labels").alias("label"))
    never = log.sparkSession.range(1).select(F.lit("never").alias("label"))
    return seen.unionByName(never).distinct()


def model_outputs(token_rows: DataFrame) -> DataFrame:
    """D17 token outputs, a stand-in for a model's forward pass: the loss of a place against the next label is
    (label mod 13) / 4; the guess of a place is its id where that is divisible by 3, else the id after it."""
    nexts = F.slice("labels", F.lit(2), F.size("labels"))
    return token_rows.withColumn("token_loss", F.transform(nexts, lambda x: F.pmod(x, F.lit(13)) / 4.0)).withColumn(
        "predictions", F.transform("input_ids", lambda x: F.when(F.pmod(x, F.lit(3)) == 0, x).otherwise(x + 1)))


def mcq_items(benchmark: DataFrame) -> DataFrame:
    """D16 science MCQ: support = text, answer = first word, distractors = next three distinct words."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    return benchmark.select(
        "item_id",
        F.col("text").alias("support"),
        F.concat(F.lit("Which word opens item "), F.col("item_id").cast("string"), F.lit("?")).alias("question"),
        F.element_at(ws, 1).alias("correct_answer"),
        F.element_at(ws, 2).alias("distractor1"),
        F.element_at(ws, 3).alias("distractor2"),
        F.element_at(ws, 4).alias("distractor3"),
    )


def option_logits(items: DataFrame) -> DataFrame:
    """Four option logits per item from md5 hex digits (stand-in for a model's scores)."""
    h = md5_key("logit", F.col("item_id"))
    return items.withColumn(
        "logits", F.array(*[(hex_int(h, 2 * j + 1, 2) / 32.0) for j in range(4)])
    )


def pair_items(benchmark: DataFrame) -> DataFrame:
    """D16 pair choice: goal = first half of the words, sol1 = second half, sol2 = second half reversed."""
    ws = F.split(F.trim("text"), r"\s+")
    half = F.floor(F.size(ws) / 2).cast("int")
    return benchmark.select(
        "item_id",
        F.array_join(F.slice(ws, 1, half), " ").alias("goal"),
        F.array_join(F.slice(ws, half + 1, F.size(ws)), " ").alias("sol1"),
        F.array_join(F.reverse(F.slice(ws, half + 1, F.size(ws))), " ").alias("sol2"),
    )


def pair_labels(benchmark: DataFrame) -> DataFrame:
    """Label file for the pairs: one int per item, item order = line order."""
    return benchmark.select("item_id", F.pmod("item_id", F.lit(2)).cast("int").alias("label"))


def pair_losses(pairs: DataFrame) -> DataFrame:
    """Token losses of both inputs (``loss1``, ``loss2``), a stand-in for a model's: (id mod 13) / 4 of every token
    but the first, of at most 1,024 tokens (the model's window)."""
    def losses(sol):
        ids = F.transform(token_pieces(F.concat_ws(" ", "goal", sol)), hashed_id)
        return F.transform(F.slice(ids, 2, PAIR_WINDOW - 1), lambda x: F.pmod(x, F.lit(13)) / 4.0)

    return pairs.withColumn("loss1", losses("sol1")).withColumn("loss2", losses("sol2"))


def class_scores(label: Column, key: Column, classes: int) -> Column:
    """Scores of ``classes`` classes, a stand-in for a model's: a digit of md5(key) each, more for the true class."""
    h = md5_key("scores", key)
    return F.array(*[(hex_int(h, j + 1, 1) + F.when(label == j, F.lit(9)).otherwise(F.lit(0))) / 4.0 for j in range(classes)])


def task_scores(labels: DataFrame, documents: DataFrame, language_ids: DataFrame) -> DataFrame:
    """D17 classification by task: (task, doc_id, label, scores). Three classes (quality + toxic) in the double evaluation,
    two in cola and mrpc, one for each language in ``language``."""
    both = F.col("quality") + F.col("toxic")
    nli = labels.select(F.when(F.pmod("doc_id", F.lit(2)) == 0, "mnli").otherwise("mnli-mm").alias("task"), "doc_id", both.cast("int").alias("label"))
    two = labels.select(F.explode(F.array(
        F.struct(F.lit("cola").alias("task"), F.col("quality").cast("int").alias("label")),
        F.struct(F.lit("mrpc").alias("task"), F.col("toxic").cast("int").alias("label")))).alias("t"), "doc_id").select("t.task", "doc_id", "t.label")
    lang = documents.join(language_ids, documents["lang"] == language_ids["label"]).select(F.lit("language").alias("task"), "doc_id", F.col("label_id").alias("label"))
    scored = [(nli, 3), (two, 2), (lang, 4)]
    parts = [t.withColumn("scores", class_scores(F.col("label"), F.concat_ws(":", "task", "doc_id"), k)) for t, k in scored]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def predictions(labels: DataFrame) -> DataFrame:
    """D17 classification: truth = quality; prediction flipped where md5(doc_id) starts below '3'."""
    h = F.md5(F.col("doc_id").cast("string"))
    flip = F.substring(h, 1, 1) < F.lit("3")
    return labels.select(
        "doc_id",
        F.col("quality").alias("label"),
        F.when(flip, F.lit(1) - F.col("quality")).otherwise(F.col("quality")).alias("prediction"),
    )


def regression_pairs(documents: DataFrame) -> DataFrame:
    """D17 regression: (n_chars, word count) as (label, prediction)."""
    return documents.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("label"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("prediction"),
    )
