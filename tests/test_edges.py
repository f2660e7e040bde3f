"""Edge fixtures: blanks, empty sources, ties, equal logits, retries, stream = batch."""

import math

from pyspark.sql import functions as F

from topicweave.functions.text import is_non_blank, py_strip
from topicweave.operators import evals as EV
from topicweave.operators import reweight as R
from topicweave.operators import sampling as S
from topicweave.operators import topics as T
from topicweave.sources import fixtures as FX
from topicweave.streaming import loss_stream as LS


def test_blank_and_strip(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "\u00a0\u00a0\u3000"), (5, " \t\n"), (6, "😀"), (7, " x ")]
    df = spark.createDataFrame(rows, "id int, text string")
    kept = sorted(r["id"] for r in df.where(is_non_blank(F.col("text"))).collect())
    assert kept == [6, 7]
    got = {r["id"]: r["s"] for r in df.select("id", py_strip(F.col("text")).alias("s")).collect()}
    assert got[7] == "x" and got[3] == ""


def test_empty_source_and_all_short(spark):
    totals = spark.createDataFrame([("books", 0, 0), ("code", 100, 10), ("ref", 50, 5)], "category string, total_tokens long, n_chunks long")
    spec = S.parse_ratio_spec(spark, "books:0.5,code:0.3,ref:0.1,web:0.1")
    q = {r["category"]: r for r in S.sampling_quotas(totals, spec, [1000]).collect()}
    assert q["books"]["take"] == 0 and q["web"]["n_chunks"] == 0
    assert q["code"]["take"] == 10 and q["ref"]["take"] == 5  # every source short: take all, remainder lost
    assert q["web"]["take"] == 0


def test_pair_ties_choose_first(spark):
    pairs = spark.createDataFrame([(0, "g", "a", "b", -1.0, -1.0), (1, "g", "a", "b", -2.0, -1.0)],
                                  "line_no long, goal string, sol1 string, sol2 string, score1 double, score2 double")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "line_no long, label int")
    got = {r["line_no"]: r["pred"] for r in EV.pair_choice(pairs, labels).collect()}
    assert got == {0: 0, 1: 1}


def test_equal_logits_pick_first(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0]), (2, [0.0, 2.0, 2.0, 1.0])], "item_id int, logits array<double>")
    got = {r["item_id"]: (r["pred_idx"], r["confidence"]) for r in EV.score_options(df).collect()}
    assert got[1][0] == 0 and math.isclose(got[1][1], 0.25)
    assert got[2][0] == 1


def test_valid_plus_dead_letters_is_all_clusters(spark, sf_small):
    cl = FX.clustered_text(FX.table(spark, sf_small, "documents"), 40)
    prompts = cl.select("cluster").distinct().withColumn("keywords", F.array().cast("array<string>"))
    out = T.classify_clusters(prompts, lambda c, a: T.hashed_response(c, a, "7"), max_retry=2)
    n = prompts.count()
    assert out.count() == n
    assert out.where("is_valid").count() + out.where("not is_valid").count() == n
    assert out.where("is_valid and labels is null").count() == 0


def test_stream_equals_batch(spark, sf_small):
    log = FX.loss_log(FX.table(spark, sf_small, "events"))
    src = LS.scratch(spark, "t-feed")
    files = LS.write_in_order(log, src, "step", 3)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{src}/*")
    out = LS.scratch(spark, "t-weights")
    vocab = FX.loss_vocabulary(log)
    windows = LS.Windows(out, 5, vocab=vocab, switch_after=20)
    LS.run_windows(stream, windows, out + "-ckpt").awaitTermination()
    windows.flush(spark)
    got = {(r["label"], r["window_id"]): r["weight"] for r in LS.read_stream_table(spark, out, "weights").collect()}
    want = {(r["label"], r["window_id"]): r["weight"] for r in R.topic_weights(log, vocab, 5, 20).collect()}
    assert set(got) == set(want) and LS.read_stream_table(spark, out, "late").count() == 0
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-12), k
