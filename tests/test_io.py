"""Round trips of the readers and writers in a scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from topicweave.operators import sequences as SQ
from topicweave.operators import topics as T
from topicweave.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="tw-io-")


def test_json_sources_and_splits(spark):
    d = _tmp()
    for src in ("books", "web"):
        with open(os.path.join(d, f"{src}.json"), "w") as f:
            f.write(json.dumps({"text": f"{src} one", "extra": 1}) + "\n" + json.dumps({"text": f"{src} two"}) + "\n")
    df = IO.read_json_sources(spark, {s: os.path.join(d, f"{s}.json") for s in ("books", "web")})
    assert sorted((r["category"], r["text"]) for r in df.collect()) == [
        ("books", "books one"), ("books", "books two"), ("web", "web one"), ("web", "web two")]
    assert df.columns == ["text", "category"]


def test_keyword_map_both_forms(spark):
    d = _tmp()
    kl = spark.createDataFrame([(1, ["alpha", "beta"]), (2, [])], "cluster int, keywords array<string>")
    IO.write_keyword_map(kl, os.path.join(d, "rows"))
    rows = sorted(tuple(r) for r in IO.read_keyword_map(spark, os.path.join(d, "rows")).collect())
    assert rows == [(1, 1, "alpha"), (1, 2, "beta")]
    with open(os.path.join(d, "obj.json"), "w") as f:
        json.dump({"1": ["alpha", "beta"], "2": []}, f, indent=4)
    whole = sorted(tuple(r) for r in IO.read_keyword_map(spark, os.path.join(d, "obj.json"), whole_object=True).collect())
    assert whole == rows


def test_label_lines_append_then_last_wins(spark):
    d = _tmp()
    good, bad = os.path.join(d, "labels"), os.path.join(d, "errors")
    run1 = spark.createDataFrame([("3", ["k"], ["Law"], True), ("4", ["k"], None, False)],
                                 "cluster_id string, keywords array<string>, labels array<string>, is_valid boolean")
    IO.write_label_lines(run1, good, bad)
    run2 = spark.createDataFrame([("3", ["k"], ["Time", "Time"], True)],
                                 "cluster_id string, keywords array<string>, labels array<string>, is_valid boolean")
    IO.write_label_lines(run2, good, bad)
    lines = IO.read_label_lines(spark, good)
    got = {r["cluster"]: r["labels"] for r in T.cluster_labels_last(lines).collect()}
    assert got == {3: ["Time"]}  # the later append wins
    assert spark.read.json(bad).count() == 1


def test_pair_file_positional(spark):
    d = _tmp()
    with open(os.path.join(d, "valid.jsonl"), "w") as f:
        for i in range(5):
            f.write(json.dumps({"goal": f"g{i}", "sol1": "a", "sol2": "b"}) + "\n")
    with open(os.path.join(d, "labels.lst"), "w") as f:
        f.write("\n".join(str(i % 2) for i in range(5)) + "\n")
    df = IO.read_pair_file(spark, os.path.join(d, "valid.jsonl"), os.path.join(d, "labels.lst"))
    got = sorted((r["goal"], r["label"]) for r in df.collect())
    assert got == [(f"g{i}", i % 2) for i in range(5)]


def test_user_files_extension_check(spark):
    d = _tmp()
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write("sentence,label\nhello,1\n")
    df = IO.read_user_files(spark, {"train": os.path.join(d, "train.csv")})
    assert df.count() == 1
    try:
        IO.read_user_files(spark, {"train": os.path.join(d, "train.csv"), "validation": os.path.join(d, "v.json")})
        raise AssertionError("mixed extensions must fail")
    except ValueError:
        pass


def test_shards_skip_existing(spark):
    d = os.path.join(_tmp(), "shards")
    df = spark.range(0, 40).select(F.col("id").alias("doc_id"), F.lit("train").alias("split"))
    done = SQ.written_shards(spark, d)
    todo = SQ.missing_shards(df, done, 4)
    assert todo.count() == 4
    first = SQ.assign_shard(df, 4).where("shard < 2")
    SQ.write_shards(first, d)
    todo = SQ.missing_shards(df, SQ.written_shards(spark, d), 4)
    assert sorted(r["shard"] for r in todo.collect()) == [2, 3]
    SQ.write_shards(SQ.assign_shard(df, 4).where("shard >= 2"), d)
    assert spark.read.parquet(d).count() == 40


def test_state_snapshot(spark):
    d = os.path.join(_tmp(), "state")
    assert IO.read_state(spark, d) is None
    w = spark.createDataFrame([("a", 1, 1.5, 0.2), ("a", 2, 2.0, 0.3), ("b", 2, 0.5, 0.1)],
                              "label string, window_id long, weight double, loss_ema double")
    IO.write_state(w, d)
    got = {r["label"]: (r["window_id"], r["weight"]) for r in IO.read_state(spark, d).collect()}
    assert got == {"a": (2, 2.0), "b": (2, 0.5)}


def test_state_replay_and_all_columns(spark):
    d = os.path.join(_tmp(), "state")
    schema = "label string, window_id long, weight double, loss_ema double, stage int, sample_count long"
    one = spark.createDataFrame([("a", 1, 1.5, 0.2, 0, 4), ("b", 1, 1.0, 0.1, 0, 2)], schema)
    two = spark.createDataFrame([("a", 2, 2.0, 0.3, 1, 7), ("b", 2, 0.5, 0.1, 1, 1)], schema)
    for part in (one, two, two):  # the last window is written again
        IO.write_state(part, d)
    assert spark.read.parquet(d).count() == 4
    got = {r["label"]: r.asDict() for r in IO.read_state(spark, d).collect()}
    assert got["a"] == {"label": "a", "window_id": 2, "weight": 2.0, "loss_ema": 0.3, "stage": 1, "sample_count": 7}


def test_vocabulary_round_trip(spark):
    d = os.path.join(_tmp(), "vocab")
    IO.write_vocabulary(spark.createDataFrame([(["Law", "Time"],), (["Law"],), ([],)], "labels array<string>"), d)
    assert sorted(r["label"] for r in IO.read_vocabulary(spark, d).collect()) == ["Law", "Time"]


def test_pair_files_of_several_parts(spark):
    d = _tmp()
    n, items, labels = 0, os.path.join(d, "items"), os.path.join(d, "labels")
    os.mkdir(items)
    os.mkdir(labels)
    for k, rows in enumerate((5, 40, 8)):  # the largest part is not the first one
        with open(os.path.join(items, f"part-{k}.jsonl"), "w") as f:
            for i in range(n, n + rows):
                f.write(json.dumps({"goal": f"g{i}", "sol1": "a", "sol2": "b"}) + "\n")
        n += rows
    for k, (a, b) in enumerate(((0, 30), (30, n))):
        with open(os.path.join(labels, f"part-{k}.txt"), "w") as f:
            f.write("".join(f"{i}\n" for i in range(a, b)))
    got = sorted((r["line_no"], r["goal"], r["label"]) for r in IO.read_pair_file(spark, items, labels).collect())
    assert got == [(i, f"g{i}", i) for i in range(n)]
    with open(os.path.join(labels, "part-2.txt"), "w") as f:
        f.write("1\n")
    try:
        IO.read_pair_file(spark, items, labels).collect()
        raise AssertionError("unequal numbers of lines must fail")
    except Exception as e:  # noqa: BLE001 - the job's own error, whatever class carries it
        assert "no partner for line" in str(e)


def test_bad_label_lines(spark):
    lines = spark.createDataFrame(
        [(1, '{"cluster_id": "3", "labels": ["Law"]}'), (2, "{broken"), (3, '{"cluster_id": "x", "labels": ["Law"]}'), (4, " "), (5, "[]")],
        "line_no long, value string")
    assert [(r["cluster"], r["labels"]) for r in T.cluster_labels_last(lines).collect()] == [(3, ["Law"])]
    assert sorted(r["line_no"] for r in T.bad_label_lines(lines).collect()) == [2, 3, 5]


def test_csv_labels_are_numbers(spark, tmp_path):
    (tmp_path / "train.csv").write_text("sentence1,label\na,0\nb,1\n")
    (tmp_path / "dev.csv").write_text("sentence1,label\nc,2.5\n")
    df = IO.read_user_files(spark, {"train": str(tmp_path / "train.csv"), "dev": str(tmp_path / "dev.csv")})
    assert {(r.sentence1, float(r.label), r.split) for r in df.collect()} == {("a", 0.0, "train"), ("b", 1.0, "train"), ("c", 2.5, "dev")}
    assert df.schema["label"].dataType.typeName() == "double"


def test_tables_splits_and_named_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, category string")
    IO.write_table(df, f"{tmp_path}/t", ["category"])
    assert sorted(tuple(r) for r in IO.read_table(spark, f"{tmp_path}/t", ["doc_id", "category"]).collect()) == [(1, "x"), (2, "y")]
    assert "category=x" in os.listdir(f"{tmp_path}/t")
    IO.write_table(df.select("text"), f"{tmp_path}/train")
    for name, texts in (("dev", ["d1"]), ("test", ["t1", "t2"])):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    splits = IO.read_splits(spark, f"{tmp_path}/train", f"{tmp_path}/dev.json", f"{tmp_path}/test.json")
    assert sorted((r.split, r.text) for r in splits.collect()) == [("dev", "d1"), ("test", "t1"), ("test", "t2"), ("train", "a"), ("train", "b")]
    splits.write.parquet(f"{tmp_path}/all")
    registry = {"corpus": f"{tmp_path}/all", "plain": f"{tmp_path}/train"}
    assert IO.read_dataset(spark, registry, "corpus", "test").count() == 2 and IO.read_dataset(spark, registry, "plain", "test").count() == 2


def test_one_folder_per_target(spark, tmp_path):
    from topicweave.operators import sampling as S

    sample = spark.createDataFrame([(10, "books", i, 0, "t", 1) for i in range(5)] + [(20, "books", i, 0, "t", 1) for i in range(9)],
                                   "target long, category string, doc_id long, chunk_no int, text string, effective_tokens int")
    S.write_sample(sample.repartition(2), f"{tmp_path}/s", max_records_per_file=2)
    assert spark.read.parquet(f"{tmp_path}/s/target=10").count() == 5 and spark.read.parquet(f"{tmp_path}/s/target=20").count() == 9
    assert len([f for f in os.listdir(f"{tmp_path}/s/target=20") if f.startswith("part")]) >= 5
