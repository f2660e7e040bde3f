"""Metrics, label ids and loss rates outside the registered fixtures' values."""

from pyspark.sql import functions as F

from topicweave.operators import evals as E
from topicweave.operators import reweight as R


def test_accuracy_counts_every_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 2)], "label int, prediction int")
    assert {r.metric: r.value for r in E.classification_metrics(df).collect()}["accuracy"] == 0.75
    only_two = E.classification_metrics(df.where("label = 2"), ("accuracy", "f1"), "_mm").collect()
    assert {r.metric: r.value for r in only_two} == {"accuracy_mm": 1.0, "f1_mm": 0.0, "combined_score_mm": 0.5}


def test_a_batch_without_targets_has_no_accuracy(spark):
    df = spark.createDataFrame([("a", 1.0, 0, 0), ("a", 1.0, 1, 2)], "subset string, loss double, correct long, targets long")
    assert {r.subset: r.mean_acc for r in E.perplexity_by_subset(df).collect()}["a"] == 0.5


def test_config_ids_hold_only_for_a_full_match(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    ids = E.label_ids(df)
    got = lambda cfg: {r.label: r.label_id for r in E.map_label_ids(df, ids, cfg).collect()}
    assert got({"B": 0, "X": 1}) == got({"B": 0, "A": 1}) == got(None) == {"a": 0, "b": 1, "c": 2}
    assert got({"B": 0, "X": 1, "A": 2}) == {"a": 0, "b": 1, "c": 2}
    assert got({"B": 0, "C": 1, "A": 2}) == {"a": 2, "b": 0, "c": 1}


def test_a_previous_loss_of_zero_is_unset(spark):
    df = spark.createDataFrame([(1, 0.0, 10), (2, 3.0, 20), (3, 1.5, 30)], "eval_no long, valid_loss double, eval_step long")
    got = {r.eval_no: (r.decrease_rate, r.switches_stage) for r in R.loss_decrease_rate(df, 15).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (0.5, 1)}


def test_the_last_finished_step_stays(spark):
    log = spark.range(10 * 2).select(F.col("id").alias("sample_id"))  # ten micro-batches of two: steps fire at 0, 4, 8
    got = R.microbatch_steps(log, 2, 4)
    assert sorted({(r.micro_batch, r.opt_step) for r in got.collect()}) == [(0, 1)] + [(m, 2) for m in range(1, 5)] + [(m, 3) for m in range(5, 9)]
