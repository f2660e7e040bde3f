"""Evaluation metrics over prediction and score tables (AG10-AG14, FN1-FN9, ST10, ST11, WN2, JN2, SE3, SK7).

Model forward passes are outside Spark; these operators start from score tables. Every
metric is a partial+final aggregate; running and rank-based metrics use bucketed prefix
sums (``functions.ranking``) instead of a single-task global window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.hashing import md5_key
from topicweave.functions.ranking import average_ranks, global_row_number, quantile_buckets, running_totals

OPTION_LETTERS = ("A", "B", "C", "D")

# Sentence columns of the sentence-pair benchmark tasks.
TASK_TO_KEYS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}
# The metrics of the tasks; all others have accuracy alone.
TASK_METRICS = {
    "cola": ("matthews_correlation",),
    "mrpc": ("accuracy", "f1"),
    "qqp": ("accuracy", "f1"),
}
CONFIDENCE_THRESHOLD = 0.5
IGNORE = -100  # a label that is no target

# The one-shot example of the multiple-choice prompt.
SHOT_EXAMPLE = {
    "support": (
        "Without Coriolis Effect the global winds would blow north to south or south to north. But Coriolis "
        "makes them blow northeast to southwest or the reverse in the Northern Hemisphere. The winds blow "
        "northwest to southeast or the reverse in the southern hemisphere."
    ),
    "question": (
        "What phenomenon makes global winds blow northeast to southwest or the reverse in the northern "
        "hemisphere and northwest to southeast or the reverse in the southern hemisphere?"
    ),
    "options": ("coriolis effect", "muon effect", "centrifugal effect", "tropical effect"),
    "answer": "A",
}


def token_sums(
    rows: DataFrame,
    labels: str = "labels",
    losses: str = "token_loss",
    predictions: str = "predictions",
    loss_shift: int = 1,
    accuracy_shift: int = 0,
    ignore: int = IGNORE,
) -> DataFrame:
    """FN4 + FN11 + PF6 + AG10 over token arrays: one row of sums per row of parallel arrays.

    Place i of ``losses`` is the loss against the label ``loss_shift`` places on, place i of
    ``predictions`` the guess for the label ``accuracy_shift`` places on. Labels equal to ``ignore``
    (or null) count in neither, and a target without a loss not in the loss. Adds ``loss_sum``, ``loss_targets``, ``loss_width`` (places, ignored
    ones included), ``n_targets`` and ``n_correct``; a null or empty array has no targets.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))

    def paired(values: str, shift: int) -> Column:
        counted = lambda lab, v: F.struct((F.coalesce(lab != ignore, F.lit(False))).alias("on"), lab.alias("lab"), v.alias("v"))
        width = F.greatest(F.size(some(labels)) - shift, F.lit(0))
        return F.zip_with(F.slice(some(labels), F.lit(1 + shift), width), F.slice(some(values), F.lit(1), width), counted)

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"))
    known = lambda x: x["on"] & x["v"].isNotNull()
    loss = F.aggregate(paired(losses, loss_shift), start, lambda acc, x: F.struct(
        (acc["n"] + known(x).cast("bigint")).alias("n"), (acc["total"] + F.when(known(x), x["v"].cast("double")).otherwise(F.lit(0.0))).alias("total")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("hit"))
    hits = F.aggregate(paired(predictions, accuracy_shift), start, lambda acc, x: F.struct(
        (acc["n"] + x["on"].cast("bigint")).alias("n"), (acc["hit"] + (x["on"] & F.coalesce(x["lab"] == x["v"], F.lit(False))).cast("bigint")).alias("hit")))
    width = F.greatest(F.size(some(labels)) - loss_shift, F.lit(0)).cast("bigint")
    return rows.withColumns({"_loss": loss, "_hits": hits, "loss_width": width}).withColumns({
        "loss_sum": F.col("_loss.total"), "loss_targets": F.col("_loss.n"), "n_targets": F.col("_hits.n"), "n_correct": F.col("_hits.hit"),
    }).drop("_loss", "_hits")


def sample_loss() -> Column:
    """FN4: a row's mean loss over all its shifted places, ignored ones included (null without any)."""
    return F.try_divide("loss_sum", "loss_width")


def batch_losses(sums: DataFrame, *by: str) -> DataFrame:
    """AG10: the rows of ``token_sums`` reduced to batches: (by..., loss, targets, correct); loss is the mean over
    targets, null for a batch without any."""
    return sums.groupBy(*by).agg(
        F.try_divide(F.sum("loss_sum"), F.sum("loss_targets")).alias("loss"),
        F.sum("n_targets").cast("long").alias("targets"), F.sum("n_correct").cast("long").alias("correct"))


def sequence_score(losses: Column) -> Column:
    """FN5: minus the mean of a sequence's token losses (null for none)."""
    total = F.aggregate(losses, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return -F.try_divide(total, F.size(losses).cast("double"))


def perplexity_by_subset(batches: DataFrame) -> DataFrame:
    """AG10 + AG11 + FN1: per batch acc = correct/targets and ppl = exp(loss); means per subset
    and over all batches (subset '__all__'). Overall ppl is the mean of batch ppl, not exp(mean loss).
    A batch without targets has neither loss nor accuracy and enters no mean."""
    b = batches.select(
        "subset", "loss", F.try_divide("correct", "targets").alias("acc"), F.exp("loss").alias("ppl")
    )
    r = b.rollup("subset").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg("loss").alias("mean_loss"),
        F.avg("acc").alias("mean_acc"),
        F.avg("ppl").alias("mean_ppl"),
        F.grouping("subset").alias("_total"),
    )
    return r.select(
        F.when(F.col("_total") == 1, F.lit("__all__")).otherwise(F.col("subset")).alias("subset"),
        "n_batches", "mean_loss", "mean_acc", "mean_ppl",
    )


def _qa_block(support: Column, question: Column, options: Column, answer: Column | None) -> Column:
    parts = [F.lit("Context: "), support, F.lit("\n\nQuestion: "), question, F.lit("\n\nOptions:\n")]
    for i, letter in enumerate(OPTION_LETTERS):
        parts += [F.lit(f"{letter}. "), F.element_at(options, i + 1), F.lit("\n")]
    parts.append(F.lit("\nAnswer: "))
    if answer is not None:
        parts += [answer, F.lit("\n\n")]
    return F.concat(*parts)


def mcq_prompts(items: DataFrame, seed: str = "mcq", include_shot: bool = False) -> DataFrame:
    """ST10 + FN8: options shuffled by md5(seed:item:option); correct_idx = first option equal to the answer."""
    opts = F.array("correct_answer", "distractor1", "distractor2", "distractor3")
    keyed = F.transform(opts, lambda o, i: F.struct(md5_key(seed, F.col("item_id"), i).alias("k"), o.alias("o")))
    shuffled = F.transform(F.array_sort(keyed), lambda s: s["o"])
    out = items.withColumn("options", shuffled).withColumn(
        "correct_idx", (F.array_position("options", F.col("correct_answer")) - 1).cast("int")
    )
    prompt = _qa_block(F.col("support"), F.col("question"), F.col("options"), None)
    if include_shot:
        ex = SHOT_EXAMPLE
        shot = _qa_block(F.lit(ex["support"]), F.lit(ex["question"]), F.array(*[F.lit(o) for o in ex["options"]]), F.lit(ex["answer"]))
        prompt = F.concat(shot, prompt)
    return out.withColumn("prompt", prompt)


def score_options(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """FN2: softmax over option logits; pred = first argmax; confidence = max probability."""
    lg = F.col(logits_col)
    mx = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    probs = F.transform(ex, lambda e: e / tot)
    out = df.withColumn("probs", probs)
    return out.withColumn("confidence", F.array_max("probs")).withColumn(
        "pred_idx", (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    )


def mcq_metrics(scored: DataFrame) -> DataFrame:
    """AG12: accuracy, correct/total, low-confidence count and percent, mean probability per option."""
    correct = (F.col("pred_idx") == F.col("correct_idx")).cast("int")
    low = (F.col("confidence") < CONFIDENCE_THRESHOLD).cast("int")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.sum(correct).cast("long").alias("correct"),
        F.avg(correct).alias("accuracy"),
        F.sum(low).cast("long").alias("low_confidence"),
        (F.avg(low) * 100).alias("low_confidence_pct"),
    ] + [F.avg(F.element_at("probs", i + 1)).alias(f"avg_prob_{l.lower()}") for i, l in enumerate(OPTION_LETTERS)]
    return scored.agg(*aggs)


def running_accuracy(scored: DataFrame, every: int = 10, n_buckets: int = 1024) -> DataFrame:
    """WN2: running accuracy and low-confidence count at every ``every``-th item in item order.

    Items are dealt by quantiles of their ids, so ids may be spread over all 64 bits; the offsets are a running sum over
    at most ``n_buckets`` rows.
    """
    s = scored.select(
        "item_id",
        (F.col("pred_idx") == F.col("correct_idx")).cast("long").alias("c"),
        (F.col("confidence") < CONFIDENCE_THRESHOLD).cast("long").alias("lo"),
    )
    rt = running_totals(quantile_buckets(s, "item_id", "_q", n_buckets), [F.col("item_id")], F.col("_q"), ["c", "lo"])
    return rt.where(F.pmod("_rows", F.lit(every)) == 0).select(
        F.col("_rows").alias("total"), (F.col("cum_c") / F.col("_rows")).alias("running_accuracy"),
        F.col("cum_lo").alias("low_confidence_so_far"),
    )


def pair_scores(pairs: DataFrame) -> DataFrame:
    """FN5: ``score1`` and ``score2`` of both inputs from their token losses (``loss1``, ``loss2``: arrays)."""
    return pairs.withColumns({"score1": sequence_score(F.col("loss1")), "score2": sequence_score(F.col("loss2"))})


def pair_choice(pairs: DataFrame, labels: DataFrame, key: str = "line_no") -> DataFrame:
    """ST11 + JN2: inputs goal+' '+sol, pred = 1 if score2 > score1 else 0 (ties -> 0),
    joined with the label file by line position."""
    j = pairs.join(labels, key)
    pred = F.when(F.col("score2") > F.col("score1"), 1).otherwise(0)
    return j.withColumn("input1", F.concat_ws(" ", "goal", "sol1")).withColumn(
        "input2", F.concat_ws(" ", "goal", "sol2")
    ).withColumn("pred", pred)


def pair_columns(columns: Sequence[str], task: str | None = None) -> tuple[str, str | None]:
    """PF9: which columns hold the sentence(s): the task's pair, else sentence1/sentence2,
    else the first two non-label columns (or one)."""
    if task is not None:
        return TASK_TO_KEYS[task]
    if "sentence1" in columns and "sentence2" in columns:
        return "sentence1", "sentence2"
    rest = [c for c in columns if c != "label"]
    return (rest[0], rest[1]) if len(rest) >= 2 else (rest[0], None)


def select_pair(df: DataFrame, task: str | None = None) -> DataFrame:
    a, b = pair_columns(df.columns, task)
    cols = [F.col(a).alias("text_a"), (F.col(b) if b else F.lit(None).cast("string")).alias("text_b")]
    return df.select(*cols, *([F.col("label")] if "label" in df.columns else []))


def pair_accuracy(choices: DataFrame) -> DataFrame:
    return choices.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("pred") == F.col("label")).cast("int")).cast("long").alias("correct"),
        F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"),
        F.sum((F.col("score1") == F.col("score2")).cast("int")).cast("long").alias("n_ties"),
    )


def label_ids(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AG14 + SO10: sorted distinct labels -> ids 0..n-1, and num_labels. Labels are numbered within their first letter."""
    d = df.select(F.col(label_col).cast("string").alias("label")).distinct()
    numbered = global_row_number(d, [F.col("label")], F.coalesce(F.substring("label", 1, 1), F.lit("")), "_rn")
    return numbered.select("label", (F.col("_rn") - 1).cast("int").alias("label_id"), d.agg(F.count(F.lit(1))).scalar().alias("num_labels"))


def map_label_ids(df: DataFrame, ids: DataFrame, config_map: dict[str, int] | None = None, label_col: str = "label") -> DataFrame:
    """FN9: label -> id by the model config when every label matches it case-insensitively,
    else (any label or config key without a partner) by sorted order; label -1 stays -1."""
    if config_map:
        lower = {k.lower(): v for k, v in config_map.items()}
        seen = ids.agg(F.count_distinct(F.lower("label")).alias("n"), F.count_if(~F.lower("label").isin(*lower)).alias("other")).first()
    if config_map and seen.n == len(lower) and not seen.other:
        cfg = ids.sparkSession.createDataFrame([(k, v) for k, v in lower.items()], "lk string, cfg_id int")
        ids = ids.join(F.broadcast(cfg), F.lower(ids["label"]) == cfg["lk"], "left").select(
            "label", F.coalesce("cfg_id", "label_id").alias("label_id"), "num_labels"
        )
    lk = ids.select(F.col("label").alias("_lbl"), "label_id")
    j = df.join(lk, F.col(label_col).cast("string") == F.col("_lbl"), "left").drop("_lbl")
    return j.withColumn("label_id", F.when(F.col(label_col).cast("string") == "-1", -1).otherwise(F.col("label_id")))


def predicted_class(scores: Column) -> Column:
    """FN3: index of the first largest score; NaN counts as the largest, null scores and no scores as none."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def confusion(pred: DataFrame, *by: str) -> DataFrame:
    """One (by..., label, prediction, n) table that all class metrics come from: at most classes squared rows a task."""
    return pred.where(F.col("label").isNotNull()).groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(table: DataFrame, *by: str) -> DataFrame:
    """AG13 from a confusion table, for any number of classes: (by..., accuracy, f1, matthews_correlation).

    F1 is that of class 1 against the rest; Matthews' coefficient is the general one, from the margins. Both are
    0 where they are undefined.
    """
    if not by:
        return class_metrics(table.withColumn("_all", F.lit(1)), "_all").drop("_all")
    n, same = F.col("n").cast("double"), F.col("label") == F.col("prediction")
    one, guess = F.col("label").cast("string") == "1", F.coalesce(F.col("prediction").cast("string") == "1", F.lit(False))
    sums = table.groupBy(*by).agg(
        F.sum(n).alias("s"), F.sum(F.when(same, n).otherwise(0.0)).alias("c"),
        F.sum(F.when(one & guess, n).otherwise(0.0)).alias("tp"), F.sum(F.when(~one & guess, n).otherwise(0.0)).alias("fp"), F.sum(F.when(one & ~guess, n).otherwise(0.0)).alias("fn"))
    # both margins of a class side by side: true and predicted rows
    side = lambda c, t, p: table.select(*by, F.col(c).cast("string").alias("class"), (n * t).alias("t"), (n * p).alias("p"))
    margins = side("label", 1, 0).unionByName(side("prediction", 0, 1)).groupBy(*by, "class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    of = margins.groupBy(*by).agg(F.sum(F.col("t") * F.col("p")).alias("tp2"), F.sum(F.col("t") ** 2).alias("t2"), F.sum(F.col("p") ** 2).alias("p2"))
    both = sums.join(of, list(by))
    spread = F.sqrt((F.col("s") ** 2 - F.col("p2")) * (F.col("s") ** 2 - F.col("t2")))
    return both.select(
        *by, F.try_divide("c", "s").alias("accuracy"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"),
        F.when(spread > 0, (F.col("c") * F.col("s") - F.col("tp2")) / spread).otherwise(F.lit(0.0)).alias("matthews_correlation"))


def named_metrics(values: DataFrame, metrics: Sequence[str], suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., metric, value) rows of the columns ``metrics``; their mean as ``combined_score`` where there are several
    (SE3: names end in ``suffix``)."""
    named = [(m, F.col(m)) for m in metrics]
    if len(metrics) > 1:
        named.append(("combined_score", reduce(lambda a, b: a + b, (F.col(m) for m in metrics)) / len(metrics)))
    rows = F.array(*[F.struct(F.lit(name + suffix).alias("metric"), value.alias("value")) for name, value in named])
    return values.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.metric", "m.value")


def classification_metrics(pred: DataFrame, metrics: Sequence[str] = ("accuracy",), suffix: str = "") -> DataFrame:
    """AG13 of one task: (metric, value) rows."""
    return named_metrics(class_metrics(confusion(pred)), metrics, suffix)


def task_metrics(pred: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """AG13 + SE3 by task: (task, metric, value) rows from (task, label, prediction) rows, each task by its own
    metrics; all tasks share one confusion table. The second half of a double evaluation (``-mm``) has its metrics named ``_mm``."""
    values = class_metrics(confusion(pred, "task"), "task")
    found = [named_metrics(values.where(F.col("task") == t), TASK_METRICS.get(t, ("accuracy",)), "_mm" if t.endswith("-mm") else "", ("task",)) for t in tasks]
    return reduce(DataFrame.unionByName, found)


def regression_metrics(pairs: DataFrame, n_buckets: int = 1024) -> DataFrame:
    """AG13: Pearson, Spearman (Pearson of average ranks), MSE; combined_score = mean(pearson, spearman)."""
    # the two quantile sketches are eager jobs and the final aggregate is a third one; the three
    # numeric columns are written once to the shared folder so the (possibly expensive)
    # derivation of label/prediction runs once, not three times
    from topicweave.sources.io import materialize

    base = materialize(pairs.select("doc_id", "label", "prediction"), "regression-pairs")
    rx = average_ranks(base, "label", "rank_label", n_buckets)
    rxy = average_ranks(rx, "prediction", "rank_prediction", n_buckets)
    r = rxy.agg(
        F.corr("label", "prediction").alias("pearson"),
        F.corr("rank_label", "rank_prediction").alias("spearmanr"),
        F.avg((F.col("label") - F.col("prediction")) ** 2).alias("mse"),
        F.count(F.lit(1)).alias("n"),
    )
    return r.withColumn("combined_score", (F.col("pearson") + F.col("spearmanr")) / 2)


def prediction_rows(
    pred: DataFrame,
    index_col: str,
    value: Column,
    is_regression: bool,
    label_names: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """FN3 + SK7: (index, prediction) rows; regression as '%.3f', classification by label name (``value`` is the
    class index; an index without a name gives null)."""
    if is_regression:
        out = F.format_string("%.3f", value)
    elif label_names:
        out = F.get(F.array(*[F.lit(n) for n in label_names]), value.cast("int"))
    else:
        out = value.cast("string")
    return pred.select(*keep, F.col(index_col).alias("index"), out.alias("prediction"))


def class_prediction_rows(pred: DataFrame, index_col: str, scores: Column, ids: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """FN3 + SK7: (keep..., index, prediction) with the name of the best-scored class, looked up in the ``label_ids`` table."""
    best = pred.select(*keep, F.col(index_col).alias("index"), predicted_class(scores).alias("label_id"))
    return best.join(ids.select("label_id", F.col("label").alias("prediction")), "label_id", "left").select(*keep, "index", "prediction")


def write_predictions(rows: DataFrame, path: str) -> None:
    """SK7: tab-separated ``index<TAB>prediction`` with a header (one part file per task)."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
