"""Topic choice per cluster and label attachment (ST6-ST8, TL1, TL2, SC5, AG5, AG6, PF4, JN1).

The language model that picks topics is external. ``classify_clusters`` takes responses as a
column expression of (cluster, attempt) and keeps the first valid one within ``max_retry``
tries; ``classify_with`` calls a user's Python responder, one pass over the open clusters a try.
Replies are parsed and judged in one place (``parse_labels``, ``labels_valid``).

``choose_topics`` is a choice that needs no model: it weighs a cluster's keywords by a lexicon.
``hashed_response`` wraps a choice into well-formed and malformed replies, so that parsing,
validation, retries and dead letters see every case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.functions.hashing import hex_int, md5_key
from topicweave.functions.text import py_strip

# The 41 topic categories, in their given order.
CATEGORIES = (
    "Academic_disciplines", "Business", "Communication", "Concepts", "Culture", "Economy",
    "Education", "Energy", "Engineering", "Entertainment", "Entities", "Ethics", "Food_and_drink",
    "Geography", "Government", "Health", "History", "Human_behavior", "Humanities", "Information",
    "Internet", "Knowledge", "Language", "Law", "Life", "Lists", "Literature", "Mass_media",
    "Mathematics", "Military", "Nature", "People", "Philosophy", "Politics", "Religion", "Science",
    "Society", "Sports", "Technology", "Time", "Universe",
)

# The classification prompt; {keywords} is the first 50 keywords joined by ", "
# and {labels} the categories joined by ", ".
PROMPT_TEMPLATE = """
Task: Select one to three most related topic labels based on the given keywords.

[Keywords]
{keywords}

[Topic labels]
{labels}

Based on the given keywords, please select one to three most relevant labels from the provided topic labels.
Ensure that the selected labels best capture the primary concepts and topics represented by the keywords.

Note:
1. The selected labels must be from the given topic labels!
2. Don't respond any reasoning process or explanations!

You must respond with the following format, and don't respond anything else:
### Labels: Label1, Label2

Examples:
### Labels: xxxx, xxxx, ...
"""

LABEL_MARKER = "### Labels:"
PROMPT_KEYWORDS = 50
MAX_RETRY = 5
MAX_LABELS = 3

D8_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
])


def categories_col() -> Column:
    return F.array(*[F.lit(c) for c in CATEGORIES])


def topic_prompts(keyword_lists: DataFrame) -> DataFrame:
    """ST6 + SO2: (cluster, keywords, prompt) with the first 50 keywords."""
    head, rest = PROMPT_TEMPLATE.split("{keywords}")
    mid, tail = rest.split("{labels}")
    kw = F.array_join(F.slice("keywords", 1, PROMPT_KEYWORDS), ", ")
    prompt = F.concat(F.lit(head), kw, F.lit(mid + ", ".join(CATEGORIES) + tail))
    return keyword_lists.select("cluster", "keywords", prompt.alias("prompt"))


def parse_labels(response: Column) -> Column:
    """ST7: text after the last marker (all of it without one), stripped, split on ',', each stripped."""
    after = F.element_at(F.split(response, LABEL_MARKER, -1), -1)
    return F.transform(F.split(py_strip(after), ",", -1), lambda x: py_strip(x))


def labels_valid(labels: Column) -> Column:
    """ST8: non-empty and every label in the vocabulary (one bad label fails all)."""
    return (F.size(labels) > 0) & F.forall(labels, lambda x: x.isin(*CATEGORIES))


def choose_topics(keyword_lists: DataFrame, lexicon: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """TL1 without a model: (cluster, choice) from the first 50 keywords and a lexicon of (keyword, label) rows.

    A keyword of rank r gives each of its labels 51 - r points. The choice is the ``max_labels`` labels with the most
    points, ties in the order of the categories, without those below half of the best; a cluster
    with no keyword in the lexicon chooses none. Equi-join on the keyword, partial sums by (cluster, label),
    then at most 41 labels a cluster.
    """
    words = keyword_lists.select("cluster", F.posexplode(F.slice("keywords", 1, PROMPT_KEYWORDS)).alias("pos", "keyword"))
    known = lexicon.where(F.col("label").isin(*CATEGORIES)).select("keyword", "label").distinct()
    points = words.join(known, "keyword").groupBy("cluster", "label").agg(F.sum(PROMPT_KEYWORDS - F.col("pos")).alias("points"))
    place = F.array_position(categories_col(), F.col("label"))
    ranked = points.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("less"), place.alias("place"), "label"))).alias("r"))
    best = F.element_at("r", 1)["less"]
    choice = F.transform(F.filter(F.slice("r", 1, max_labels), lambda x: 2 * x["less"] <= best), lambda x: x["label"])
    return keyword_lists.select("cluster").join(ranked.select("cluster", choice.alias("choice")), "cluster", "left").select(
        "cluster", F.coalesce("choice", F.array().cast("array<string>")).alias("choice"))


def hashed_response(cluster: Column, attempt: Column, seed: str = "1", choice: Column | None = None) -> Column:
    """Offline stand-in for the model's reply, its form by md5(seed, cluster, attempt); names the labels of ``choice``,
    or some by the same digest."""
    h = md5_key(seed, cluster, attempt)
    variant = F.pmod(hex_int(h, 1, 1), F.lit(8))
    n = F.pmod(hex_int(h, 2, 1), F.lit(3)) + 1
    picks = F.array(*[F.element_at(categories_col(), (F.pmod(hex_int(h, 3 + 2 * j, 2), F.lit(41)) + 1).cast("int")) for j in range(3)])
    chosen = F.array_join(F.slice(picks, F.lit(1), n.cast("int")) if choice is None else choice, ", ")
    m = F.lit(LABEL_MARKER + " ")
    return (
        F.when(variant <= 2, F.concat(m, chosen))
        .when(variant == 3, F.concat(m, F.lower(chosen)))
        .when(variant == 4, chosen)
        .when(variant == 5, F.concat(m, F.lit("Nothing\n"), m, chosen))
        .when(variant == 6, F.concat(m, chosen, F.lit("\n")))
        .otherwise(F.lit(""))
    )


def parse_attempts(prompts: DataFrame, responder: Callable[[Column, Column], Column], max_retry: int = MAX_RETRY) -> DataFrame:
    """All tries per cluster: (cluster, attempt, response, labels, is_valid)."""
    att = prompts.select("*", F.explode(F.sequence(F.lit(1), F.lit(max_retry))).alias("attempt"))
    att = att.withColumn("response", responder(F.col("cluster"), F.col("attempt")))
    att = att.withColumn("labels", parse_labels(F.col("response")))
    return att.withColumn("is_valid", labels_valid(F.col("labels")))


def classify_clusters(prompts: DataFrame, responder: Callable[[Column, Column], Column], max_retry: int = MAX_RETRY) -> DataFrame:
    """TL1: first valid try within ``max_retry``; (cluster_id, keywords, labels, attempt, is_valid).

    ``is_valid`` false rows are the dead letters (one per cluster, no labels).
    """
    tries = F.transform(
        F.sequence(F.lit(1), F.lit(max_retry)),
        lambda a: F.struct(a.alias("attempt"), parse_labels(responder(F.col("cluster"), a)).alias("labels")),
    )
    good = F.filter(tries, lambda t: labels_valid(t["labels"]))
    first = F.element_at(good, 1)
    return prompts.select(
        F.col("cluster").cast("string").alias("cluster_id"),
        "keywords",
        F.when(F.size(good) > 0, first["labels"]).alias("labels"),
        F.when(F.size(good) > 0, first["attempt"]).alias("attempt"),
        (F.size(good) > 0).alias("is_valid"),
    )


def classify_with(prompts: DataFrame, respond: Callable[[str, int], str], max_retry: int = MAX_RETRY) -> DataFrame:
    """TL1 with a user responder (e.g. a model client) called from the executors.

    ``respond(prompt, attempt) -> str``; an exception is a reply of null, an invalid try. Each try is one
    pass over the clusters that are still open, its replies written before they are judged, so no prompt
    is asked twice; after ``max_retry`` tries the rest are dead letters (the unbounded retry on errors
    is not reproduced).
    """
    from topicweave.sources.io import materialize

    open_rows = prompts.select(F.col("cluster").cast("string").alias("cluster_id"), "keywords", "prompt")
    fields = open_rows.schema.fields
    found = None
    for attempt in range(1, max_retry + 1):
        def ask(batches, attempt=attempt):
            for pdf in batches:
                yield pdf.assign(response=[_reply(respond, prompt, attempt) for prompt in pdf["prompt"]])

        replies = open_rows.mapInPandas(ask, T.StructType([*fields, T.StructField("response", T.StringType())]))
        judged = materialize(replies, f"replies-{attempt}").withColumn("labels", parse_labels(F.col("response")))
        judged = judged.withColumn("is_valid", F.coalesce(labels_valid(F.col("labels")), F.lit(False)))
        good = judged.where("is_valid").select("cluster_id", "keywords", "labels", F.lit(attempt).alias("attempt"), "is_valid")
        found = good if found is None else found.unionByName(good)
        open_rows = judged.where("not is_valid").select("cluster_id", "keywords", "prompt")
    dead = open_rows.select("cluster_id", "keywords", F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("int").alias("attempt"), F.lit(False).alias("is_valid"))
    return dead if found is None else found.unionByName(dead)


def _reply(respond: Callable[[str, int], str], prompt: str, attempt: int) -> str | None:
    try:
        return respond(prompt, attempt)
    except Exception:  # noqa: BLE001 - a failed call is a failed try
        return None


def label_lines(classified: DataFrame, run: int) -> DataFrame:
    """SK4 shape: valid rows as JSON lines with a (run, cluster) line order."""
    ok = classified.where("is_valid")
    return ok.select(
        F.struct(F.lit(run).alias("run"), F.col("cluster_id").cast("long").alias("pos")).alias("line_no"),
        F.to_json(F.struct("cluster_id", "keywords", "labels")).alias("value"),
    )


def _parsed_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value, cluster, labels) of the non-blank lines; cluster is null where a line is no label record."""
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", D8_SCHEMA))
    return parsed.select("line_no", "value", F.col("r.cluster_id").try_cast("int").alias("cluster"), F.col("r.labels").alias("labels"))


def cluster_labels_last(lines: DataFrame) -> DataFrame:
    """SC5 + AG5 + PF4: parse JSON lines, skip blank and bad ones, last line per cluster wins, keep vocabulary labels.

    Output (cluster INT, labels ARRAY<STRING>) with labels de-duplicated and sorted. Lines that are
    no JSON object or name no integer cluster are listed by ``bad_label_lines``.
    """
    last = _parsed_lines(lines).where("cluster is not null").groupBy("cluster").agg(F.max_by("labels", "line_no").alias("labels"))
    return last.select(
        "cluster", F.array_sort(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), categories_col())).alias("labels")
    )


def bad_label_lines(lines: DataFrame) -> DataFrame:
    """The error output of ``cluster_labels_last``: (line_no, value) of the lines it cannot use."""
    return _parsed_lines(lines).where("cluster is null").select("line_no", "value")


def attach_topics(clustered: DataFrame, cluster_labels: DataFrame) -> DataFrame:
    """TL2 + JN1: left join on cluster; a cluster without labels gets [] (never null).

    The label table has one row per cluster (k rows); the planner's byte threshold decides whether it is broadcast.
    """
    return clustered.join(cluster_labels, "cluster", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>"))
    )


def commonest_label(vocabulary: DataFrame) -> str | None:
    """The label of most rows, ties by name; None for an empty vocabulary."""
    top = vocabulary.orderBy(F.desc("n_rows"), "label").first()
    return top["label"] if top else None


def label_vocabulary(labelled: DataFrame) -> DataFrame:
    """AG6: distinct labels with their row counts."""
    return labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
