"""Per-cluster keyword extraction (ST3-ST5, SO1, AG3, AG4).

TF-IDF is fitted per cluster, like one vectorizer per cluster: tokens are words of two or
more word characters, tf is the raw count, idf = ln((1 + n) / (1 + df)) + 1 with n the
cluster's non-blank documents, each document's vector is L2-normalised, and a term's score
is the sum over the cluster's documents. Texts are never collected per cluster: the work
is term counts inside the document rows and partial+final aggregates, so a cluster holding a third
of all documents spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions.text import NON_WORD_RUN, normalise_words, words

# The English stop-word list the keyword step filters with (179 words).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't",
    "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren",
    "weren't", "won", "won't", "wouldn", "wouldn't",
)


HOT_TERMS = 4096  # terms whose idf is broadcast, whatever the vocabulary


def stop_words(lang: str = "english") -> list[str]:
    """ST4: stop words by language; English is the fixed list, others come from Spark's lists."""
    if lang == "english":
        return list(ENGLISH_STOP_WORDS)
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(lang))


def normalise_keywords(df: DataFrame, stops: Sequence[str] | None = None, text_col: str = "text") -> DataFrame:
    """ST3: ``contents`` = lower-cased text, non-word runs -> ' ', stop words removed when given.

    The stop filter is an IN over a literal list, which Spark turns into a hash-set lookup.
    """
    norm = normalise_words(F.col(text_col))
    if stops:
        kept = F.filter(words(norm), lambda w: ~w.isin(*stops))
        contents = F.array_join(kept, " ")
    else:
        contents = norm
    return df.withColumn("contents", contents)


def term_counts(tokens: Column) -> Column:
    """Structs (term, tf) of an array of words: sorted, then one entry for each run of equal ones."""
    def runs(ws):
        heads = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.coalesce(F.get(ws, i) != F.get(ws, i - 1), F.lit(True)))
        counted = lambda hs: F.transform(hs, lambda h, j: F.struct(F.get(ws, h).alias("term"), (F.coalesce(F.get(hs, j + 1), F.size(ws)) - h).alias("tf")))
        return F.get(F.transform(F.array(heads), counted), F.lit(0))

    found = F.get(F.transform(F.array(F.array_sort(tokens)), runs), F.lit(0))
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def row_terms(rows: DataFrame, stops: Sequence[str] | None = None) -> DataFrame:
    """(cluster, row, terms) from (cluster, row, words): structs (term, tf) of each row's words of two and more characters.
    Empty strings and stop words count as no words, and rows without any word are left out. Words are numbered
    within an Arrow batch and counted as numbers; rows stay where they are."""
    dropped = ["", *(stops or ())]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(2)
            word = lists.flatten().dictionary_encode()
            known, code = word.dictionary, word.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            counts = ~pc.is_in(known, pa.array(dropped, known.type)).to_numpy(zero_copy_only=False)
            long = pc.greater_equal(pc.utf8_length(known), 2).to_numpy(zero_copy_only=False)
            row, code = row[counts[code]], code[counts[code]]
            kept = np.unique(row)  # a one-letter word counts as text
            row, code = row[long[code]], code[long[code]]
            pair, tf = np.unique(row * max(len(known), 1) + code, return_counts=True)
            row, code = pair // max(len(known), 1), pair % max(len(known), 1)
            cut = np.append(np.searchsorted(row, kept), len(row)).astype(np.int32)
            terms = pa.StructArray.from_arrays([known.take(pa.array(code)).cast(pa.string()), pa.array(tf.astype(np.int32))], names=["term", "tf"])
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(pa.array(cut), terms)], names=["cluster", "row", "terms"])

    kind = rows.schema["cluster"].dataType.simpleString()
    return rows.select("cluster", "row", "words").mapInArrow(run, f"cluster {kind}, row bigint, terms array<struct<term:string,tf:int>>")


def _with_idf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """The term rows with their idf. Those of the ``HOT_TERMS`` terms in most documents meet it on the map side (a table of
    fixed size), so no task gets all rows of a common term; the rest is joined as the planner sees fit."""
    hot = F.broadcast(idf.orderBy(F.desc("df"), "cluster", "term").limit(HOT_TERMS))
    keys = ["cluster", "term"]
    return tf.join(hot, keys).unionByName(tf.join(hot.select(*keys), keys, "left_anti").join(idf, keys))


def cluster_tfidf(clustered: DataFrame, stops: Sequence[str] | None = None) -> DataFrame:
    """ST5 + AG4: (cluster, term, score) with per-cluster smooth idf and L2-normalised documents.

    Each document's words become one array of (term, count) in its own row, written once without the text: no shuffle.
    Document frequencies, the documents' norms and the scores are partial sums over the exploded arrays;
    a term's idf is a common factor of its score, so it is looked up for the norms and once more for the
    sums, never carried along. Term rows travel uncombined in one place only, the lookup of rare
    terms' idf where its table is too large for the planner to broadcast.
    """
    from topicweave.sources.io import materialize

    # a number for each row: ids may be missing or used twice
    rows = clustered.select("cluster", F.monotonically_increasing_id().alias("row"), F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), NON_WORD_RUN).alias("words"))
    docs = materialize(row_terms(rows, stops), "doc-terms")
    tf = docs.select("cluster", "row", F.inline("terms"))
    n_docs = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"))
    dfreq = tf.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = materialize(dfreq.join(n_docs, "cluster").select(
        "cluster", "term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "term-idf")
    weight = F.col("tf") * F.col("idf")
    norms = _with_idf(tf, idf).groupBy("cluster", "row").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    shares = docs.join(norms, ["cluster", "row"]).select("cluster", "norm", F.inline("terms")).groupBy("cluster", "term").agg(F.sum(F.col("tf") / F.col("norm")).alias("share"))
    return shares.join(idf, ["cluster", "term"]).select("cluster", "term", (F.col("share") * F.col("idf")).alias("score"))


def top_keywords(scores: DataFrame, top_n: int = 100) -> DataFrame:
    """SO1: top ``top_n`` terms per cluster by score desc, ties in term order (stable sort on sorted features).

    ``row_number() <= literal`` lets Spark apply a partial group limit before the shuffle.
    """
    w = Window.partitionBy("cluster").orderBy(F.round("score", 8).desc(), F.col("term"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(
        "cluster", "rank", F.col("term").alias("keyword"), "score"
    )


def keyword_lists(clustered: DataFrame, top: DataFrame) -> DataFrame:
    """AG3: (cluster, keywords ARRAY<STRING>) in rank order; clusters without any text get [].

    One group per cluster holds at most ``top_n`` keywords.
    """
    lists = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("_kw"))
    lists = lists.select("cluster", F.transform("_kw", lambda x: x["keyword"]).alias("keywords"))
    clusters = clustered.select("cluster").distinct()
    return clusters.join(lists, "cluster", "left").select(
        "cluster", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")
    )


def extract_keywords(clustered: DataFrame, top_n: int = 100, lang: str = "english", remove_stopwords: bool = True) -> DataFrame:
    """The keyword job: (cluster, keywords)."""
    stops = stop_words(lang) if remove_stopwords else None
    return keyword_lists(clustered, top_keywords(cluster_tfidf(clustered, stops), top_n))
