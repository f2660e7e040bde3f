import re
from collections import Counter

import duckdb
import pytest

from topicweave.llm import line_rules as L

GOOD = "A plain sentence of several words stands here, and it ends.\n"
EDGES = [None, "", " \n \t", "word", GOOD * 8, GOOD + "Home | About | Contact\n" * 30, "x " * 600, "a b c\x0bd e f " * 40, "all RIGHTS reserved.\n" * 20 + GOOD,
         "日本 の 文。 " * 40, "no marks at all in this line of words\n" * 9, "Home\nLogin\nSign up / Help\n" + "One more sentence, that differs %d.\n" % 3, "#*$%&|<> " * 60,
         "nb space stays in one word. " * 5, "\r\n".join(f"Line number {i} ends well." for i in range(30)), "long " * 300_000 + "."]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    lost = 0
    for x in lines:
        bare = x.strip(" \t\n\x0b\x0c\r")
        bad = re.search(L.NAVIGATION, bare, re.I) or re.search(L.BOILERPLATE, bare, re.I) or not (bare[-1] in L.ENDS or re.search(r"[.!?] ", bare))
        lost += len(re.findall(r"[^\x20\x09-\x0d]+", x)) if bad else 0
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed, lost, not failed and 2 * lost <= len(words)


def test_equals_brute_force(make_docs):
    rows = list(enumerate(EDGES)) + [(4, EDGES[4]), (None, "no id")]
    docs = make_docs(rows).selectExpr("*", "1 as kept", "2 as n_words", "3 as id")
    got = sorted((tuple(r)[:9] for r in L.judge_lines(docs, with_text=False).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert L.judge_lines(docs.limit(0)).count() == 0


def test_cleaned_text_has_the_passing_lines(make_docs):
    out = L.judge_lines(make_docs([(1, GOOD + "Home | About | Contact\nAnother sentence ends.\n")])).first()
    assert out.cleaned == GOOD + "Another sentence ends."


def test_oracle_on_edges(make_docs):
    rows = [(i, t) for i, t in enumerate(EDGES) if t is None or len(t) < 10_000]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[i, t] for i, t in rows])
    cur = con.execute(L.RULES_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall())
    df = L.judge_lines(make_docs(rows), with_text=False).withColumnRenamed("id", "doc_id")
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_documents_of_good_quality_stay(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    good = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("quality = 1").selectExpr("doc_id as id")
    got = L.judge_lines(docs, with_text=False).join(good, "id").where("n_words >= 50").collect()
    assert sum(r.kept for r in got) >= 0.99 * len(got)
