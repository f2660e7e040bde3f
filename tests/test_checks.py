"""Data checks, metric snapshots, order over sparse ids."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from topicweave.operators import checks as CK
from topicweave.operators import evals as E


def rules():
    return {"positive": F.col("x") > 0, "short": F.length("t") < 3}


def frame(spark):
    return spark.createDataFrame([(1, 5, "a"), (2, -1, "abc"), (3, None, "b"), (4, 7, None)], "id int, x int, t string")


def test_observed_counts_come_with_the_main_job(spark):
    df, seen = CK.observed(frame(spark), rules())
    assert df.where("id > 0").count() == 4
    assert seen.get == {"n_rows": 4, "positive": 2, "short": 2}


def test_violations_and_enforcement(spark):
    got = {(r.rule, r.id) for r in CK.violations(frame(spark), rules(), ["id"]).collect()}
    assert got == {("positive", 2), ("short", 2), ("positive", 3), ("short", 4)}
    assert CK.enforced(frame(spark).where("id = 1"), rules()).collect() == frame(spark).where("id = 1").collect()
    with pytest.raises(PySparkException, match="broken rules: positive, short"):
        CK.enforced(frame(spark).where("id = 2"), rules()).collect()
    with pytest.raises(PySparkException, match="broken rules"):
        CK.enforced(frame(spark), rules()).count()


def test_metrics_are_appended_every_n_steps(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    assert [CK.log_metrics(spark, {"loss": 1.0 / (s + 1), "acc": s}, s, path, every=5) for s in range(0, 12)] == [s % 5 == 0 for s in range(12)]
    got = {(r.step, r.metric): r.value for r in spark.read.parquet(path).collect()}
    assert set(got) == {(s, m) for s in (0, 5, 10) for m in ("loss", "acc")} and got[10, "acc"] == 10.0


@pytest.mark.parametrize("n_buckets", [2, 1024])
def test_running_accuracy_over_ids_spread_over_64_bits(spark, n_buckets):
    rng = random.Random(1)
    ids = sorted({rng.choice([rng.randint(-(2**62), 2**62), rng.randint(0, 50), 2**61 + rng.randint(0, 40)]) for _ in range(300)})
    rows = [(i, rng.randint(0, 1), 0, rng.random()) for i in ids]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "item_id long, pred_idx int, correct_idx int, confidence double").repartition(5)
    got = {r.total: (r.running_accuracy, r.low_confidence_so_far) for r in E.running_accuracy(df, 7, n_buckets).collect()}
    want = {k: (sum(r[1] == 0 for r in rows[:k]) / k, sum(r[3] < 0.5 for r in rows[:k])) for k in range(7, len(rows) + 1, 7)}
    assert got == want


def test_label_ids_are_in_byte_order(spark):
    labels = ["b", "a", "", "éa", "Z", "ab", "aa", "日"]
    got = E.label_ids(spark.createDataFrame([(x,) for x in labels * 2], "label string")).collect()
    assert {r.label: r.label_id for r in got} == {x: i for i, x in enumerate(sorted(labels, key=str.encode))}
    assert {r.num_labels for r in got} == {len(labels)}
