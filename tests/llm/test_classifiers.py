import random
import zlib

import numpy as np
import pytest

from topicweave.llm import language, quality, toxicity
from topicweave.llm import queries as Q

SF = "/root/testdata/sf0.1"


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        rank[p == v] = rank[p == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def toy(make_docs, spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 2
        words = [rng.choice(["the", "of", "sun", "moon", "tree"]) + str(rng.randint(0, 3)) for _ in range(40)]
        if bad:
            words[5::10] = ["nasty"] * len(words[5::10])
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad, bad))
    return rows, make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("op,column,least", [(Q.op3_toxicity, "toxic", 0.8), (Q.op5_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, op, column, least):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    rows = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    assert auc(np.array([y for y, _ in rows]), np.array([p for _, p in rows])) > least


def test_language_accuracy_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in Q.op6_language(spark, SF).collect() if r.held_out]
    right = [truth[r.doc_id] == r.lang_pred for r in got]
    sure = [truth[r.doc_id] == r.lang_pred for r in got if not r.rejected]
    assert sum(right) > 0.97 * len(right) and sum(sure) > 0.98 * len(sure) > 0.9 * len(right)


def test_toxicity_finds_the_word_and_nothing_else(make_docs, spark):
    rows, docs, labels = toy(make_docs, spark)
    extra = make_docs([(1001, "the1 of2 nasty sun0 nasty moon1 nasty"), (1002, "the1 of2 sun0 moon1 tree3"), (1003, None), (1004, ""), (None, "sun1"), (1001, "moon2"), (1005, "nasty " * 50_000)])
    clash = docs.unionByName(extra).selectExpr("*", "1 as score", "2 as label", "3 as id", "4 as part")
    got = {}
    for r in toxicity.toxicity(clash, labels).collect():
        got.setdefault(r.id, []).append(r.score)
    assert sum(len(v) for v in got.values()) == len(rows) + 7
    assert all((got[i][0] >= 0.5) == (i % 2 == 1) for i, _ in rows)
    assert max(got[1001]) > 0.5 > min(got[1001]) and got[1002][0] < 0.5 and got[1003] == got[1004] and got[1003][0] < 0.5
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 2 == 0}


def test_labels_that_teach_nothing(make_docs, spark):
    docs = make_docs([(1, "a b c"), (2, None)])
    for rows in ([], [(1, None, None)], [(1, 1, 1), (1, 0, 0)], [(i, 1, 1) for i in range(50)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        for op in (toxicity.toxicity, quality.quality):
            scores = {r.score for r in op(docs, labels).collect()}
            assert len(scores) == 1 and 0 < scores.pop() < 1
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learned(make_docs, spark):
    _, docs, labels = toy(make_docs, spark, 200)
    lies = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic")
    for op in (toxicity.toxicity, quality.quality):
        a, b = ({r.id: r.score for r in op(docs, x).collect()} for x in (labels, lies))
        assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_training_sample_is_the_lowest_hashes_of_each_class(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 20 = 0 as int) as toxic")
    picked, _ = toxicity.training_sample(labels, "toxic", 100)
    got = {c: {r.doc_id for r in picked.collect() if r.label == c} for c in (0, 1)}
    rows = toxicity.labelled(labels, "toxic").selectExpr("doc_id", "label", "xxhash64(doc_id) as h").collect()
    assert got == {c: {r.doc_id for r in sorted((r for r in rows if r.label == c), key=lambda r: (r.h, r.doc_id))[:100]} for c in (0, 1)}


def test_statistics_of_edge_texts():
    from topicweave.llm import textbytes as tb
    import pyarrow as pa

    texts = [None, "", "a", "x y x y x y x y", "Ä!! 12 |", "\n\n", "same line\nsame line\nother"]
    parts = [quality.statistics(d, o) for _, d, o in tb.text_slices(pa.array(texts, pa.string()))]
    x = np.concatenate(parts)
    assert x.shape == (7, len(quality.NAMES)) and np.isfinite(x).all() and not x[0].any() and not x[1].any()
    col = dict(zip(quality.NAMES, x.T))
    assert np.isclose(col["words"][3], np.log1p(8)) and np.isclose(col["repeated_triples"][3], np.sqrt(4 / 6))
    assert np.isclose(col["repeated_lines"][6], np.sqrt(1 / 3)) and np.isclose(col["bars"][4], np.sqrt(1 / 9))


def test_language_edges(make_docs):
    rows = [(i, "le chat est sur la table et la porte " * 3, "fr") if i % 3 else (i, "the cat is on the table and the door " * 3, "en") for i in range(90)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 456 !!", "en"), (203, "le chat sur la table", None), (204, "日本語", None), (None, "the door", "en"), (205, "the cat is on the table " * 40_000, None)]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as score", "3 as lang_pred", "4 as order_")
    got = {r.id: (r.lang_pred, r.score) for r in language.languages(docs).collect()}
    assert all(got[i][0] == ("fr" if i % 3 else "en") for i in range(90))
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[203][0] == "fr" and got[205][0] == "en" and got[204][0] in ("fr", "en")
    none = make_docs([(1, "text", None)])
    assert language.languages(none).first().lang_pred == "und" and language.languages(none.limit(0)).count() == 0


def test_language_weighs_the_whole_of_long_texts(make_docs, spark):
    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 1").select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text or "")
    join = lambda lang, n: " ".join(texts[lang][300:])[:n]
    learn = make_docs([(i, t, lang) for lang in ("en", "fr", "de") for i, t in enumerate(texts[lang][:300])])
    rows = [(1, join("fr", 30_000) + " " + join("de", 400_000)), (2, join("de", 30_000) + " " + join("fr", 400_000)), (3, join("en", 2_000)), (4, join("en", 700_000))]
    got = {r.id: r for r in language.languages(make_docs(rows), learn).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[4].lang_pred) == ("de", "fr", "en")
    assert not any(r.rejected for r in got.values()) and abs(got[3].score - got[4].score) < 0.05


def test_language_dictionaries_come_from_anywhere_in_a_text(make_docs):
    head = "cookies privacy terms login home " * 40  # more than a piece, the same in both languages
    rows = [(i, head + (("le chat est sur la table et la porte ", "the cat is on the table and the door ")[i % 2] * 100), ("fr", "en")[i % 2]) for i in range(80)]
    content = language.dictionaries(make_docs(rows))
    assert b"le chat est" in content["fr"] and b"the cat is" in content["en"]


def test_toxic_phrases_of_ordinary_words_count_and_copied_passages_do_not(make_docs, spark):
    rng = random.Random(9)
    common = [f"w{k}" for k in range(12)]
    notice = " ".join(f"w{k * 5 % 12}" for k in range(60))
    rows, labels = [], []
    for i in range(1200):
        bad, words = i % 2, [rng.choice(common) for _ in range(60)]
        if i % 20 == 1:  # a tenth of the toxic ones
            words[20:20] = ["you", "go", "home", "now"]
        else:  # the same words everywhere, in other orders
            words[20:20] = rng.choice([["now", "go", "you", "home"], ["home", "you", "now", "go"], ["go", "now", "home", "you"]])
        text = " ".join(words)
        if i % 2 and i % 8 == 3:  # copies of a passage in toxic documents
            text += " " + notice
        rows.append((i, text))
        labels.append((i, 1 - bad, bad))
    model = toxicity.fit(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    from topicweave.llm import textbytes as tb
    import pyarrow as pa

    tests = ["w1 you go home now w2", "w1 now go you home w2", notice[60:120]]
    f = np.concatenate([model.features(d, o) for _, d, o in tb.text_slices(pa.array(tests))])
    assert f[0, 0] > 0.5 and f[0, 0] > f[1, 0] + 0.5 and abs(f[2, 0]) < 0.3


def test_discounts_of_counts():
    d = toxicity.discounts(np.repeat([1, 2, 3, 4, 9], [100, 40, 20, 12, 5]))
    y = 100 / 180
    assert np.allclose(d, [0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])
