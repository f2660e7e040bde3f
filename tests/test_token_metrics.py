"""Token-array sums and class metrics against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicweave.operators import evals as E


def plain_sums(labels, losses, guesses, loss_shift, accuracy_shift):
    shifted = [(y, v) for y, v in zip((labels or [])[loss_shift:], losses or []) if y not in (None, -100) and v is not None]
    hits = [(y, p) for y, p in zip((labels or [])[accuracy_shift:], [*(guesses or []), *[None] * 99]) if y not in (None, -100)]
    return sum(v for _, v in shifted), len(shifted), max(len(labels or []) - loss_shift, 0), len(hits), sum(y == p for y, p in hits)


@pytest.mark.parametrize("loss_shift,accuracy_shift", [(1, 0), (0, 0), (1, 1)])
def test_token_sums_equal_plain_python(spark, loss_shift, accuracy_shift):
    rng = random.Random(3)
    rows = [(k, [rng.choice([-100, None, 1, 2, 3]) for _ in range(n)], [rng.choice([0.5, 2.0, None]) for _ in range(n - 1)], [rng.choice([1, 2, None]) for _ in range(n)])
            for k, n in enumerate([1, 2, 5, 9, 9])]
    rows += [(10, [], [], []), (11, None, None, None), (12, [-100] * 4, [1.0] * 3, [1] * 4), (13, [1, 2, 3], [1.0], [1])]
    df = spark.createDataFrame(rows, "id int, labels array<int>, token_loss array<double>, predictions array<int>")
    got = E.token_sums(df, loss_shift=loss_shift, accuracy_shift=accuracy_shift).collect()
    for r in got:
        want = plain_sums(r.labels, r.token_loss, r.predictions, loss_shift, accuracy_shift)
        assert (r.loss_sum, r.loss_targets, r.loss_width, r.n_targets, r.n_correct) == want, r


def test_a_batch_without_targets_has_no_loss_and_enters_no_mean(spark):
    rows = [("en", 0, [1, 2], [4.0], [1, 1]), ("en", 1, [-100, -100], [9.0], [1, 1]), ("de", 0, [-100, 7], [2.0], [1, 7])]
    df = spark.createDataFrame(rows, "subset string, batch_id int, labels array<int>, token_loss array<double>, predictions array<int>")
    batches = E.batch_losses(E.token_sums(df), "subset", "batch_id")
    assert {(r.subset, r.batch_id): (r.loss, r.targets, r.correct) for r in batches.collect()} == {("en", 0): (4.0, 2, 1), ("en", 1): (None, 0, 0), ("de", 0): (2.0, 1, 1)}
    got = {r.subset: r for r in E.perplexity_by_subset(batches).collect()}
    assert got["en"].mean_loss == 4.0 and got["en"].mean_acc == 0.5 and got["en"].n_batches == 2
    assert got["__all__"].mean_ppl == pytest.approx((math.exp(4) + math.exp(2)) / 2)
    assert E.token_sums(df).select(E.sample_loss().alias("x")).collect()[1].x == 0.0


def test_sequence_score(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "l array<double>")
    assert [r.s for r in df.select(E.sequence_score(F.col("l")).alias("s")).collect()] == [-1.5, None, None]


def plain_metrics(pairs):
    n, t, p = len(pairs), Counter(y for y, _ in pairs), Counter(x for _, x in pairs)
    c = sum(y == x for y, x in pairs)
    den = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    tp, off = sum(y == x == 1 for y, x in pairs), sum((y == 1) != (x == 1) for y, x in pairs)
    return c / n, 2 * tp / (2 * tp + off) if tp + off else 0.0, (c * n - sum(t[k] * p[k] for k in t)) / den if den else 0.0


@pytest.mark.parametrize("classes", [1, 2, 3, 5])
def test_class_metrics_for_any_number_of_classes(spark, classes):
    rng = random.Random(classes)
    pairs = [(y := rng.randrange(classes), y if rng.random() < 0.6 else rng.randrange(classes + 1)) for _ in range(80)]
    df = spark.createDataFrame([("a", *p) for p in pairs] + [("b", 1, 1), ("b", 0, 1), ("b", None, 1)], "task string, label int, prediction int")
    rows = {r.task: r for r in E.class_metrics(E.confusion(df, "task"), "task").collect()}
    for task, want in (("a", plain_metrics(pairs)), ("b", plain_metrics([(1, 1), (0, 1)]))):
        assert (rows[task].accuracy, rows[task].f1, rows[task].matthews_correlation) == pytest.approx(want)
    whole = E.class_metrics(E.confusion(df.where("task = 'a'"))).first()
    assert whole.asDict() == {k: v for k, v in rows["a"].asDict().items() if k != "task"}


def test_combined_score_only_for_several_metrics_and_the_second_evaluation_has_a_suffix(spark):
    rows = [(t, y, p) for t in ("mnli", "mnli-mm", "mrpc", "cola", "qnli") for y, p in ((0, 0), (1, 1), (1, 0), (2, 2))]
    got = {(r.task, r.metric) for r in E.task_metrics(spark.createDataFrame(rows, "task string, label int, prediction int"), ["mnli", "mnli-mm", "mrpc", "cola", "qnli"]).collect()}
    assert got == {("mnli", "accuracy"), ("mnli-mm", "accuracy_mm"), ("mrpc", "accuracy"), ("mrpc", "f1"), ("mrpc", "combined_score"), ("cola", "matthews_correlation"), ("qnli", "accuracy")}


def test_predicted_class_and_names(spark, tmp_path):
    rows = [(0, [0.1, 0.7, 0.7]), (1, [float("nan"), 1.0, 2.0]), (2, []), (3, None), (4, [3.0])]
    df = spark.createDataFrame(rows, "index int, scores array<double>")
    assert [r.c for r in df.select(E.predicted_class(F.col("scores")).alias("c")).collect()] == [1, 0, None, None, 0]
    ids = E.label_ids(spark.createDataFrame([("no",), ("maybe",), ("yes",), ("no",)], "label string"))
    named = E.class_prediction_rows(df, "index", F.col("scores"), ids)
    assert {r["index"]: r.prediction for r in named.collect()} == {0: "no", 1: "maybe", 2: None, 3: None, 4: "maybe"}
    by_list = E.prediction_rows(df.withColumn("c", E.predicted_class(F.col("scores"))), "index", F.col("c"), False, ["maybe", "no", "yes"])
    assert {r["index"]: r.prediction for r in by_list.collect()} == {0: "no", 1: "maybe", 2: None, 3: None, 4: "maybe"}
    E.write_predictions(named, f"{tmp_path}/out")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == ["index", "prediction"] and {(r["index"], r.prediction) for r in back.collect()} >= {("0", "no"), ("4", "maybe")}
