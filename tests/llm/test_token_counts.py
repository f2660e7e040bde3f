import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicweave.llm import token_counts as TC

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [None, "", " ", "a", " lead", "trail ", "two  blanks", "tab\tand\nline", "it's we'll 123 4,5 x!!", "日本語 のテキスト", "nb sp  wide",
         "end<|endoftext|> of <|endoftext|>text", "a <b", "🙂 🙂🙂", "x" * 5000, "word " * 20_000 + "end", "é́ combined", "  a", "a 　 b"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def test_equals_the_library(make_docs, library, spark, sf_small):
    rows = list(enumerate(EDGES)) + [(100, "same text"), (101, "same text"), (101, "same text"), (101, "another"), (None, "no id")]
    docs = make_docs(rows).selectExpr("*", "0 as digest", "1 as id", "'x' as tokenizer")
    got = sorted(((r.id, r.n_bytes, r.n_tokens) for r in TC.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), library(t)) for i, t in rows), key=str)
    table = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    assert {r.id: r.n_tokens for r in TC.token_counts(table, PATH).collect()} == {i: library(t) for i, t in texts.items()}


def test_small_word_store_changes_nothing(library):
    counter = TC.WordCounter(open(PATH, "rb").read(), words=5)
    texts = ["one two three four", "five six seven eight nine ten", "one two"] * 3
    assert counter.count(texts) == [library(t) for t in texts]


def test_only_distinct_misses_are_encoded_and_appended(spark, make_docs, tmp_path, library):
    path = str(tmp_path / "cache")
    TC.token_counts(make_docs([(1, "a b"), (2, "a b"), (3, "c")]), PATH, path).collect()
    assert spark.read.parquet(path).count() == 2
    again = TC.token_counts(make_docs([(5, "c"), (6, "new one"), (7, "a b")]), PATH, path)
    assert {r.id: r.n_tokens for r in again.collect()} == {5: library("c"), 6: library("new one"), 7: library("a b")}
    assert spark.read.parquet(path).count() == 3
    # counts stored under another tokenizer version are not taken
    spark.read.parquet(path).selectExpr("'other' tokenizer", "digest", "n_tokens + 50 n_tokens").write.mode("append").parquet(path)
    assert TC.token_counts(make_docs([(8, "c")]), PATH, path).first().n_tokens == library("c")


def test_empty_table(make_docs):
    assert TC.token_counts(make_docs([(1, "a")]).limit(0), PATH).count() == 0
