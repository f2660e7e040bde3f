"""The weight fold against a step-by-step model of the training loop's adjustment."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from topicweave.operators import reweight as R
from topicweave.sources import fixtures as FX

SF = "/root/testdata/sf0.01"
N, SWITCH = 10, 200


def _loop_model(rows, vocab, n, first_stage1):
    """Adjust every n steps: label means, global mean of present labels, stage rules, EMAs, reset."""
    w = {v: 1.0 for v in vocab}
    ema = {v: 0.0 for v in vocab}
    s = {v: 0.0 for v in vocab}
    c = {v: 0 for v in vocab}
    by_step = defaultdict(list)
    for step, labels, loss in rows:
        by_step[step].append((labels, loss))
    max_step = max(by_step)
    out = {}
    for step in range(1, max_step + 1):
        for labels, loss in by_step.get(step, []):
            for lab in labels:
                s[lab] += loss
                c[lab] += 1
        if step % n:
            continue
        avg = {v: (s[v] / c[v] if c[v] else 0.0) for v in vocab}
        present = [avg[v] for v in vocab if c[v]]
        g = sum(present) / len(present) if present else 0.0
        for v in vocab:
            ema[v] = avg[v] if ema[v] == 0.0 else 0.9 * ema[v] + (1 - 0.9) * avg[v]
        stage = 1 if step >= first_stage1 else 0
        if g:
            for v in vocab:
                d = avg[v] - g
                if stage == 0:
                    if d > 0:
                        w[v] = min(w[v] * (1 + d / g), 5.0)
                elif d > 0:
                    w[v] = max(w[v] * (1 - d / g), 0.1)
                else:
                    w[v] = min(w[v] * (1 + abs(d / g)), 5.0)
            s = {v: 0.0 for v in vocab}
            c = {v: 0 for v in vocab}
        for v in vocab:
            out[(v, step // n)] = (w[v], ema[v])
    return out


@pytest.fixture(scope="module")
def log(spark):
    return FX.loss_log(FX.table(spark, SF, "events"))


def test_fold_equals_loop(spark, log):
    vocab_df = FX.loss_vocabulary(log)
    vocab = sorted(r["label"] for r in vocab_df.collect())
    rows = [(r["step"], r["labels"], r["loss"]) for r in log.collect()]
    model = _loop_model(rows, vocab, N, R.first_stage1_step(SWITCH, N))
    got = R.topic_weights(log, vocab_df, N, SWITCH).collect()
    assert len(got) == len(model)
    for r in got:
        w, e = model[(r["label"], r["window_id"])]
        assert math.isclose(r["weight"], w, rel_tol=1e-9), (r["label"], r["window_id"])
        assert math.isclose(r["loss_ema"], e, rel_tol=1e-9, abs_tol=1e-12)
        assert 0.1 - 1e-12 <= r["weight"] <= 5.0 + 1e-12


def test_unseen_label_doubles_in_stage1(spark, log):
    w = R.topic_weights(log, FX.loss_vocabulary(log), N, SWITCH).where(F.col("label") == "never")
    rows = {r["window_id"]: r["weight"] for r in w.collect()}
    first1 = R.first_stage1_step(SWITCH, N) // N
    assert rows[first1 - 1] == 1.0
    assert math.isclose(rows[first1], 2.0)


def test_sample_weights_use_previous_window(spark, log):
    vocab = FX.loss_vocabulary(log)
    w = R.topic_weights(log, vocab, N, SWITCH)
    sw = R.sample_weights(log, w, vocab, N)
    wmap = {(r["label"], r["window_id"]): r["weight"] for r in w.collect()}
    for r in sw.where("sample_id % 97 = 0").collect():
        win = math.ceil(r["step"] / N)
        ws = [wmap.get((lab, win - 1), 1.0) if win > 1 else 1.0 for lab in r["labels"]]
        expect = sum(ws) / len(ws) if ws else 0.0
        assert math.isclose(r["sample_weight"], expect, rel_tol=1e-12)


def test_resume_equals_full(spark, log):
    vocab = FX.loss_vocabulary(log)
    st = R.window_stats(log, vocab, N, SWITCH)
    full = {(r["label"], r["window_id"]): r["weight"] for r in R.fold_weights(st).collect()}
    first = R.fold_weights(st.where("window_id <= 12"))
    state = first.where("window_id = 12").select("label", "weight", "loss_ema")
    rest = R.fold_weights(st.where("window_id > 12"), state=state)
    for r in first.unionByName(rest).collect():
        assert math.isclose(r["weight"], full[(r["label"], r["window_id"])], rel_tol=1e-12)


def test_zero_mean_window_carries_counts(spark):
    rows = [(s, ["a"], 0.0) for s in range(1, 3)] + [(s, ["a"], 1.0) for s in range(3, 5)] + [(s, ["b"], 3.0) for s in range(3, 5)]
    log = spark.createDataFrame(rows, "step long, labels array<string>, loss double").withColumn("sample_id", F.monotonically_increasing_id())
    vocab = spark.createDataFrame([("a",), ("b",)], "label string")
    st = {(r["label"], r["window_id"]): r for r in R.window_stats(log, vocab, 2, 100).collect()}
    assert st[("a", 1)]["global_avg"] == 0.0
    assert st[("a", 2)]["sample_count"] == 4  # two carried + two new
    assert math.isclose(st[("a", 2)]["loss_avg"], 0.5)


def test_stream_folds_windows_without_labels(spark, tmp_path):
    from topicweave.streaming import loss_stream as LS

    rows = [(s, 10 * s, ["a"] if s not in (5, 6, 7, 8) else [], 1.0 + s % 3) for s in range(1, 18)]
    log = spark.createDataFrame(rows, "step long, sample_id long, labels array<string>, loss double")
    vocab = spark.createDataFrame([("a",), ("b",)], "label string")
    src, out = str(tmp_path / "feed"), str(tmp_path / "weights")
    assert LS.write_in_order(log, src, "step", 5) == 1
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    LS.run_weight_stream(stream, vocab, out, out + "-ckpt", 4, 8).awaitTermination()
    keys = ["label", "window_id", "stage", "sample_count", "loss_avg", "global_avg", "loss_ema", "weight"]
    got = sorted(tuple(r) for r in LS.read_stream_table(spark, out, "weights").select(*keys).collect())
    want = sorted(tuple(r) for r in R.topic_weights(log, vocab, 4, 8).select(*keys).collect())
    assert [w[:2] for w in want] == [(x, w) for x in "ab" for w in (1, 2, 3, 4)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(x - y) < 1e-12 for g, w in zip(got, want) for x, y in zip(g[2:], w[2:]))


def _stream_batches(spark, out, batches, vocab, every, switch, delay=0):
    from topicweave.streaming import loss_stream as LS

    windows = LS.Windows(out, every, delay, vocab, switch)
    for epoch, rows in enumerate(batches):
        windows.on_batch(spark.createDataFrame(rows, "step long, sample_id long, labels array<string>, loss double"), epoch)
    return windows, lambda table: LS.read_stream_table(spark, out, table)


def test_zero_mean_windows_carry_over_epochs_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [(s, s, ["a"] if s % 3 else ["a", "b"], 0.0 if s <= 8 or 13 <= s <= 16 else float(s % 5 + 1)) for s in range(1, 25)]
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    batches = [[r for r in rows if lo < r[0] <= lo + 3] for lo in range(0, 24, 3)]
    windows, read = _stream_batches(spark, str(tmp_path / "w"), batches, vocab, 4, 8)
    again = spark.createDataFrame(batches[-1], "step long, sample_id long, labels array<string>, loss double")
    windows.on_batch(again, len(batches) - 1)  # the last batch once more, as after a failure
    keys = ["label", "window_id", "stage", "sample_count", "loss_avg", "global_avg", "loss_ema", "weight"]
    log = spark.createDataFrame(rows, again.schema)
    want = sorted(tuple(r) for r in R.topic_weights(log, vocab, 4, 8).select(*keys).collect())
    assert sorted(tuple(r) for r in read("weights").select(*keys).collect()) == [w for w in want if w[1] < 6]  # nothing beyond step 24 seen
    windows.flush(spark)
    assert sorted(tuple(r) for r in read("weights").select(*keys).collect()) == want
    assert any(w[3] > 4 for w in want)  # carried counts


def test_late_rows_go_to_the_side_and_a_delay_lets_them_in(spark, tmp_path):
    rows = [(s, s, ["a"], float(s)) for s in range(1, 13)]
    batches = [rows[:3] + rows[5:9], rows[3:5], rows[9:]]  # steps 4 and 5 come after step 9
    vocab = spark.createDataFrame([("a",)], "label string")
    windows, read = _stream_batches(spark, str(tmp_path / "strict"), batches, vocab, 4, 100)
    windows.flush(spark)
    assert {(r.step, r.window_id) for r in read("late").collect()} == {(4, 1), (5, 2)}
    assert {r.window_id: r.loss_sum for r in read("closed").collect()} == {1: 6.0, 2: 21.0, 3: 42.0}
    windows, read = _stream_batches(spark, str(tmp_path / "patient"), batches, vocab, 4, 100, delay=5)
    windows.flush(spark)
    assert read("late").count() == 0
    assert {r.window_id: r.loss_sum for r in read("closed").collect()} == {1: 10.0, 2: 26.0, 3: 42.0}


def test_a_feed_that_goes_on_after_a_flush(spark, tmp_path):
    rows = [(s, s, ["a"], float(s)) for s in range(1, 9)]
    vocab = spark.createDataFrame([("a",)], "label string")
    windows, read = _stream_batches(spark, str(tmp_path / "w"), [rows[:4]], vocab, 4, 100)
    windows.flush(spark)
    assert {r.window_id for r in read("closed").collect()} == {1}
    windows.on_batch(spark.createDataFrame([(4, 99, ["a"], 0.5), *rows[4:]], "step long, sample_id long, labels array<string>, loss double"), 1)
    assert {r.window_id: r.loss_sum for r in read("closed").collect()} == {1: 10.5}


def test_blocks_of_windows_fold_as_one_sequence(spark, monkeypatch):
    rows = [(step, step * 3 + j, lab, ((step * 7 + j * 5) % 11) / 4.0) for step in range(1, 47) for j, lab in enumerate((["a"], ["a", "b"], []))]
    log = spark.createDataFrame(rows, "step long, sample_id long, labels array<string>, loss double")
    vocab = spark.createDataFrame([("a",), ("b",), ("never",)], "label string")
    model = _loop_model([(s, labs, x) for s, _, labs, x in rows], ["a", "b", "never"], 2, R.first_stage1_step(16, 2))
    for block in (1, 4, 23, 24):  # 23 windows
        monkeypatch.setattr(R, "FOLD_BLOCK", block)
        stats = R.window_stats(log, vocab, 2, 16)
        got = {(r.label, r.window_id): (r.weight, r.loss_ema) for r in R.fold_weights(stats).collect()}
        assert set(got) == set(model)
        assert all(math.isclose(x, y, rel_tol=1e-9) for k in model for x, y in zip(got[k], model[k]))
        ema, want = 0.0, {}
        for r in stats.where("label = 'a'").orderBy("window_id").collect():
            ema = r.global_avg if ema == 0 else 0.9 * ema + (1 - 0.9) * r.global_avg
            want[r.window_id] = ema
        assert {r.window_id: round(r.global_ema, 9) for r in R.global_ema(stats).collect()} == {k: round(v, 9) for k, v in want.items()}
