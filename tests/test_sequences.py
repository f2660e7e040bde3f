import hashlib
import math
"""Token sequences, masking rules, truncation and the distributed ranking helpers."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from topicweave.functions.ranking import average_ranks, global_row_number, running_totals, with_line_index
from topicweave.operators import sequences as SQ


def _longest_first_loop(a, b, m):
    a, b = list(a), list(b)
    while len(a) + len(b) > m:
        if len(a) > len(b):
            a.pop()
        else:
            b.pop()
    return a + b


def test_truncate_pair_matches_loop(spark):
    rng = random.Random(3)
    rows = [(i, list(range(rng.randint(0, 20))), list(range(100, 100 + rng.randint(0, 20)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a array<int>, b array<int>")
    got = {r["id"]: r["t"] for r in df.select("id", SQ.truncate_pair(F.col("a"), F.col("b"), 16).alias("t")).collect()}
    for i, a, b in rows:
        assert got[i] == _longest_first_loop(a, b, 16), (a, b)


def test_shift_right_edges(spark):
    df = spark.createDataFrame([(1, [5, 6, 2, 0, 0]), (2, [5, 6, 7, 8, 2]), (3, [5, 2, 6, 7, 8])], "id int, ids array<int>")
    got = {r["id"]: r["s"] for r in df.select("id", SQ.shift_right(F.col("ids"), 5).alias("s")).collect()}
    assert got[1] == [2, 5, 6, 0, 0]   # sep before pad becomes pad
    assert got[2] == [2, 5, 6, 7, 8]
    assert got[3] == [2, 5, 2, 6, 7]


def test_mlm_labels_consistent(spark):
    ids = [[7, 8, 9, 10, 11, 12, 13, 14, 0, 0]] * 50
    df = spark.createDataFrame([(i, x, [0] * 8 + [1, 1]) for i, x in enumerate(ids)], "doc_id long, input_ids array<int>, special_tokens_mask array<int>")
    for r in SQ.mlm_mask(df, 20).collect():
        for orig, new, lab in zip(r["input_ids"], r["mlm_input_ids"], r["mlm_labels"]):
            assert lab in (SQ.IGNORE, orig)
            if lab == SQ.IGNORE:
                assert new == orig
        assert r["mlm_labels"][8:] == [SQ.IGNORE, SQ.IGNORE]


def test_sentence_permute_keeps_tokens(spark):
    ids = [4, 5, 2, 6, 2, 7, 8, 2, 9, 2, 10, 0, 0]
    df = spark.createDataFrame([(i, ids) for i in range(20)], "doc_id long, input_ids array<int>")
    for r in SQ.permute_sentences(df, 1.0).collect():
        assert sorted(r["permuted_ids"]) == sorted(ids)
        assert r["permuted_ids"][-3:] == [10, 0, 0]
    same = SQ.permute_sentences(df, 0.0).collect()
    assert all(r["permuted_ids"] == ids for r in same)


def _infill_model(key, ids, special, ratio=0.3, lam=3.0):
    """The rule in plain Python: masked places from md5 draws."""
    plain = [i for i, x in enumerate(ids) if not special[i] and x not in (SQ.PAD, SQ.SEP)]
    budget, used, masked = math.ceil(len(plain) * ratio), 0, set()
    for h, i in sorted((hashlib.md5(f"infill:{key}:{i}".encode()).hexdigest(), i) for i in plain):
        u, n, share, total = int(h[:8], 16) / 2**32, 0, math.exp(-lam), 0.0
        while (total := total + share) <= u:
            n += 1
            share *= lam / n
        n = min(n, budget - used)
        used += n
        masked |= {j for j in plain if i <= j < i + n}
    out = [SQ.MASK if i in masked else x for i, x in enumerate(ids) if not (i in masked and i - 1 in masked)]
    return out + [SQ.PAD] * (len(ids) - len(out)), [x if i in masked else SQ.IGNORE for i, x in enumerate(ids)]


def test_span_infill_equals_the_rule(spark):
    ids = [SQ.SEP if i % 7 == 6 else 10 + i for i in range(30)] + [SQ.PAD] * 10
    rows = [(i, ids, [0] * 30 + [1] * 10) for i in range(12)] + [(100, [], []), (101, [5], [0]), (102, [SQ.SEP, SQ.PAD], [0, 1]), (103, list(range(10, 74)), [0] * 64)]
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<int>, special_tokens_mask array<int>")
    got = {r.doc_id: (r.infill_input_ids, r.infill_labels) for r in SQ.span_infill(df).collect()}
    assert got == {k: _infill_model(k, x, sp) for k, x, sp in rows}
    assert all(ids[i] not in (SQ.SEP, SQ.PAD) for k in range(12) for i, y in enumerate(got[k][1]) if y != SQ.IGNORE)


def test_shards_are_overwritten_one_by_one_without_touching_the_session(spark, tmp_path):
    path = str(tmp_path / "shards")
    assert SQ.written_shards(spark, path).count() == 0
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    SQ.write_shards(spark.createDataFrame([(1, "train", 0), (2, "train", 1)], "doc_id long, split string, shard int"), path)
    SQ.write_shards(spark.createDataFrame([(3, "train", 1)], "doc_id long, split string, shard int"), path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [1, 3]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_global_row_number_equals_window(spark):
    df = spark.range(0, 3000).withColumn("k", F.md5(F.col("id").cast("string"))).withColumn("g", F.col("id") % 3)
    a = global_row_number(df, [F.col("k")], F.substring("k", 1, 2), "rn", ("g",))
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert a.join(b, ["id"]).where("rn != rn2").count() == 0


def test_running_totals(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") % 7)
    rt = running_totals(df, [F.col("id")], F.floor(F.col("id") / 64), ["v"])
    pdf = rt.toPandas().sort_values("id")
    assert (pdf["cum_v"].values == (pd.Series(range(1, 1001)) % 7).cumsum().values).all()
    assert (pdf["_rows"].values == pdf["id"].values).all()


def test_average_ranks_with_ties(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5] * 20
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, x double")
    got = average_ranks(df, "x", "r", n_buckets=8).toPandas().sort_values("i")
    expect = pd.Series(vals, dtype=float).rank(method="average")
    assert (got["r"].values == expect.values).all()


def test_line_index_is_consecutive(spark):
    df = spark.range(0, 500, numPartitions=7).select((F.col("id") * 3).alias("v"))
    got = sorted((r["line_no"], r["v"]) for r in with_line_index(df).collect())
    assert got == [(i, 3 * i) for i in range(500)]


def test_chunk_rows_hold_whole_texts(spark):
    words = [f"w{i}{'.' if i % 3 == 0 else ''}" for i in range(150)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, ""), (4, None)], "doc_id long, text string")
    pieces = [w if i == 0 else f" {w}" for i, w in enumerate(words)]
    ids = [SQ.FIRST_ID + int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in pieces]
    got = {(r.doc_id, r.chunk_no): r.ids for r in SQ.hashed_chunks(df, 64).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert got[1, 0] + got[1, 1] + got[1, 2] == ids and len(got[1, 2]) == 22
    with_sep = {(r.doc_id, r.chunk_no): r.ids for r in SQ.hashed_chunks(df, 64, sep_after_sentence=True).collect()}
    flat = with_sep[1, 0] + with_sep[1, 1] + with_sep[1, 2]
    assert [x for x in flat if x != SQ.SEP] == ids
    assert flat.count(SQ.SEP) == 50 and max(map(len, with_sep.values())) <= 128


def test_dynamic_pad_fills_to_the_longest_of_its_batch(spark):
    df = spark.createDataFrame([(0, [5] * 3), (0, [6] * 9), (1, [7])], "batch long, ids array<bigint>")
    got = sorted((r.batch, r.padded_len, r.padded_ids) for r in SQ.dynamic_pad(df, "batch").collect())
    assert got == [(0, 16, [5] * 3 + [0] * 13), (0, 16, [6] * 9 + [0] * 7), (1, 8, [7] + [0] * 7)]


def test_separators_are_special_and_never_masked(spark):
    df = spark.createDataFrame([(1, [10, SQ.SEP, 11, 12, SQ.SEP] * 20)], "doc_id long, ids array<long>")
    row = SQ.mlm_mask(SQ.pad_sequences(df, 110), 1000, p=1.0).first()
    assert row.special_tokens_mask == [int(x == SQ.SEP) for x in row.ids] + [1] * 10
    assert [x for x, s in zip(row.mlm_input_ids, row.special_tokens_mask) if s] == [SQ.SEP] * 40 + [SQ.PAD] * 10
    assert all((y == SQ.IGNORE) == bool(s) for y, s in zip(row.mlm_labels, row.special_tokens_mask))


def test_a_vocabulary_of_the_users_own(spark):
    from topicweave.functions.tokens import token_pieces

    texts = spark.createDataFrame([(1, "b a. b"), (2, " a. b c"), (3, None), (4, "")], "doc_id long, text string")
    vocab = SQ.build_vocabulary(texts, 3)
    rows = {r.piece: r.id for r in vocab.collect()}
    assert rows == {" a.": SQ.FIRST_ID, " b": SQ.FIRST_ID + 1, " c": SQ.FIRST_ID + 2}  # by count, then by piece
    got = {r.doc_id: r.ids for r in SQ.piece_ids(texts, vocab, ["doc_id"], token_pieces(F.col("text")), sep_after_sentence=True).collect()}
    assert got[3] == got[4] == []
    want = lambda ps: [x for p in ps for x in ([rows.get(p, SQ.UNK)] + ([SQ.SEP] if p[-1] in ".!?" else []))]
    assert got[1] == want(["b", " a.", " b"]) and got[2] == want([" a.", " b", " c"])


def test_span_infill_is_one_pass_in_the_tasks_and_takes_null_keys_and_null_rows(spark):
    ids = list(range(10, 50))
    df = spark.createDataFrame([(None, 0, ids, [0] * 40), (5, 1, None, None)], "doc_id long, chunk_no int, input_ids array<long>, special_tokens_mask array<int>")
    out = SQ.span_infill(df, key=("doc_id", "chunk_no"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan
    got = {r.chunk_no: (r.infill_input_ids, r.infill_labels) for r in out.collect()}
    assert got[1] == ([], []) and len(got[0][0]) == 40
    masked = {i for i, y in enumerate(got[0][1]) if y != SQ.IGNORE}
    assert 0 < len(masked) <= 12
    assert [x for x in got[0][0] if x not in (SQ.MASK, SQ.PAD)] == [x for i, x in enumerate(ids) if i not in masked]
