"""Registered queries for keywords, topic choice, label attachment, noise and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.numeric import rounded
from topicweave.operators import clustering as C
from topicweave.operators import keywords as K
from topicweave.operators import noise as NZ
from topicweave.operators import topics as T
from topicweave.plans import sql as Q
from topicweave.sources import fixtures as FX
from topicweave.sources.io import materialize

TOP_N = 100
FIT_CLUSTERS, FIT_STEPS = 10, 4
EMBED_BUCKETS = 1024
STOPS = K.stop_words("english")


def _clustered(spark, sf, n_clusters=FX.FIXTURE_CLUSTERS):
    return FX.clustered_text(FX.table(spark, sf, "documents"), n_clusters)


def _keyword_lists(spark, sf, n_clusters=FX.FIXTURE_CLUSTERS):
    """Stage output (one row per cluster), written once to the shared folder like the keyword file."""
    cl = _clustered(spark, sf, n_clusters)
    return materialize(K.keyword_lists(cl, K.top_keywords(K.cluster_tfidf(cl, STOPS), TOP_N)), "keyword-lists")


def _asked(spark, sf, n_clusters=FX.FIXTURE_CLUSTERS):
    """Prompts with the choice that the lexicon makes from their keywords."""
    lists = _keyword_lists(spark, sf, n_clusters)
    return T.topic_prompts(lists).join(T.choose_topics(lists, FX.topic_lexicon(FX.table(spark, sf, "benchmark"))), "cluster")


def _responder(seed):
    """Replies with the prompt's choice, in a form that changes with the try."""
    return lambda c, a: T.hashed_response(c, a, seed, F.col("choice"))


def _labels_last(spark, sf):
    prompts = _asked(spark, sf)
    run1 = T.label_lines(T.classify_clusters(prompts, _responder("1")), 1)
    run2 = T.label_lines(T.classify_clusters(prompts, _responder("2")), 2)
    return materialize(T.cluster_labels_last(run1.unionByName(run2)), "cluster-labels")


def _labelled(spark, sf):
    return T.attach_topics(_clustered(spark, sf), _labels_last(spark, sf))


def _vectors(spark, sf):
    return FX.table(spark, sf, "embeddings")


def q_keyword_normalise(spark, sf):
    return K.normalise_keywords(_clustered(spark, sf), STOPS).select("doc_id", "cluster", "contents")


def q_cluster_keywords(spark, sf):
    cl = _clustered(spark, sf)
    top = K.top_keywords(K.cluster_tfidf(cl, STOPS), TOP_N)
    return top.select("cluster", "rank", "keyword", rounded("score").alias("score"))


def q_keyword_lists(spark, sf):
    kl = _keyword_lists(spark, sf)
    return kl.select("cluster", F.size("keywords").alias("n_keywords"), F.to_json("keywords").alias("keywords_json"))


def q_topic_prompts(spark, sf):
    return T.topic_prompts(_keyword_lists(spark, sf)).select("cluster", "prompt")


def q_keyword_map_roundtrip(spark, sf):
    """SK3 -> SC4 -> JN5: keyword lists written as JSON rows, read back, looked up per prompt cluster."""
    from topicweave.sources.io import read_keyword_map, scratch_path, write_keyword_map

    path = scratch_path(spark, "keywords-json")
    write_keyword_map(_keyword_lists(spark, sf), path)
    kw = read_keyword_map(spark, path)
    clusters = _clustered(spark, sf).select("cluster").distinct()
    return clusters.join(kw, "cluster").select("cluster", "rank", "keyword")


def q_topic_choice(spark, sf):
    """TL1 by lexicon: the labels that each cluster's keywords choose."""
    return _asked(spark, sf, FX.SMALL_CLUSTERS).select("cluster", F.array_join("choice", "|").alias("choice_str"))


def q_parse_responses(spark, sf):
    att = T.parse_attempts(_asked(spark, sf), _responder("1"))
    return att.select("cluster", "attempt", F.array_join("labels", "|").alias("labels_str"), F.col("is_valid").cast("int").alias("is_valid"))


def q_topic_dead_letters(spark, sf):
    """Clusters without a valid reply in all five tries: those whose keywords choose no label, and any whose replies were all malformed."""
    out = T.classify_clusters(_asked(spark, sf, FX.SMALL_CLUSTERS), _responder("1"))
    return out.where(~F.col("is_valid")).select("cluster_id", F.size("keywords").alias("n_keywords"))


def q_cluster_labels_last(spark, sf):
    return _labels_last(spark, sf).select("cluster", F.array_join("labels", "|").alias("labels_str"))


def q_attach_topics(spark, sf):
    return _labelled(spark, sf).select("doc_id", "cluster", F.array_join("labels", "|").alias("labels_str"))


def q_label_vocabulary(spark, sf):
    return T.label_vocabulary(_labelled(spark, sf))


def q_noise_shuffle(spark, sf):
    labelled = _labelled(spark, sf)
    out = NZ.inject_noise(labelled, T.commonest_label(T.label_vocabulary(labelled)))
    return out.select("doc_id", F.col("noised").cast("int").alias("noised"), "text")


def q_kmeans_assign(spark, sf):
    v = _vectors(spark, sf)
    return C.assign_nearest(v, C.centroids_by_label(v), ("vec_id", "label")).select("vec_id", "label", "cluster", rounded("distance").alias("distance"))


def q_kmeans_lloyd_step(spark, sf):
    v = _vectors(spark, sf)
    return C.lloyd_step(v, C.centroids_by_label(v)).select("cluster", "dim", rounded("value").alias("value"))


def _fitted(spark, sf):
    """Mini-batch k-means: a batch is about a quarter of the vectors."""
    v = _vectors(spark, sf)
    return v, C.fit_minibatch(v, FIT_CLUSTERS, v.count() // 4, FIT_STEPS)


def q_kmeans_fit(spark, sf):
    """CL2 + CL3: every vector's nearest centroid after FIT_STEPS mini-batches."""
    v, centroids = _fitted(spark, sf)
    return C.assign_nearest(v, centroids).select("vec_id", "cluster")


def q_kmeans_minibatch(spark, sf):
    """CL2: the centroids after FIT_STEPS mini-batches, with how many vectors each has seen."""
    return _fitted(spark, sf)[1].select("cluster", "n", F.posexplode("centroid").alias("dim", "v")).select("cluster", "n", "dim", rounded("v").alias("value"))


def q_hashing_embed(spark, sf):
    out = C.hashing_embed(FX.table(spark, sf, "documents").select("doc_id", "text"), EMBED_BUCKETS)
    top = F.array_max("embedding")
    return out.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_nonzero"),
                      (F.array_position("embedding", top) - 1).cast("int").alias("top_bucket"), top.cast("double").alias("top_value"))


QUERIES = {
    "keyword_normalise": q_keyword_normalise,
    "cluster_keywords": q_cluster_keywords,
    "keyword_lists": q_keyword_lists,
    "topic_prompts": q_topic_prompts,
    "keyword_map_roundtrip": q_keyword_map_roundtrip,
    "topic_choice": q_topic_choice,
    "parse_responses": q_parse_responses,
    "topic_dead_letters": q_topic_dead_letters,
    "cluster_labels_last": q_cluster_labels_last,
    "attach_topics": q_attach_topics,
    "label_vocabulary": q_label_vocabulary,
    "noise_shuffle": q_noise_shuffle,
    "kmeans_assign": q_kmeans_assign,
    "kmeans_lloyd_step": q_kmeans_lloyd_step,
    "kmeans_fit": q_kmeans_fit,
    "kmeans_minibatch": q_kmeans_minibatch,
    "hashing_embed": q_hashing_embed,
}

# ---------------------------------------------------------------- oracle SQL


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STOPS = "[" + ", ".join(_lit(w) for w in STOPS) + "]"
_CATS = "[" + ", ".join(_lit(c) for c in T.CATEGORIES) + "]"
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"

_CONTENTS = f"""array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '),
                                lambda w: w <> '' AND NOT list_contains({_STOPS}, w)), ' ')"""

def _kw(n_clusters: int) -> str:
    return f"""WITH {Q.clustered_cte(n_clusters)},
docs AS (SELECT cluster, doc_id, {_CONTENTS} AS contents FROM clustered),
d2 AS (SELECT * FROM docs WHERE regexp_matches(contents, '[^ ]')),
nd AS (SELECT cluster, COUNT(*) AS n_docs FROM d2 GROUP BY cluster),
terms AS (SELECT cluster, doc_id, unnest(string_split(contents, ' ')) AS term FROM d2),
tf AS (SELECT cluster, doc_id, term, COUNT(*) AS tf FROM terms WHERE length(term) >= 2 GROUP BY ALL),
dfq AS (SELECT cluster, term, COUNT(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf.cluster, tf.doc_id, tf.term, tf.tf * (ln((nd.n_docs + 1) / (dfq.df + 1)) + 1) AS w
      FROM tf JOIN dfq ON tf.cluster = dfq.cluster AND tf.term = dfq.term JOIN nd ON nd.cluster = tf.cluster),
wn AS (SELECT *, sqrt(SUM(w * w) OVER (PARTITION BY cluster, doc_id)) AS norm FROM w),
sc AS (SELECT cluster, term, SUM(w / norm) AS score FROM wn GROUP BY ALL),
rk AS (SELECT cluster, term, score, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY round(score, 8) DESC, term) AS rank FROM sc),
top AS (SELECT cluster, rank, term AS keyword, score FROM rk WHERE rank <= {TOP_N}),
kl AS (SELECT c.cluster, coalesce(list(t.keyword ORDER BY t.rank) FILTER (WHERE t.keyword IS NOT NULL), CAST([] AS VARCHAR[])) AS keywords
       FROM (SELECT DISTINCT cluster FROM clustered) c LEFT JOIN top t ON t.cluster = c.cluster GROUP BY c.cluster)"""


_KW = _kw(FX.FIXTURE_CLUSTERS)

_HEAD, _REST = T.PROMPT_TEMPLATE.split("{keywords}")
_MID, _TAIL = _REST.split("{labels}")
_PROMPT = f"({_lit(_HEAD)} || array_to_string(keywords[1:{T.PROMPT_KEYWORDS}], ', ') || {_lit(_MID + ', '.join(T.CATEGORIES) + _TAIL)})"


def _asked_sql(n_clusters: int) -> str:
    return _kw(n_clusters) + f""",
lex AS (SELECT DISTINCT w AS keyword, {Q.hexint('md5(w)', 2, 4)} % {len(T.CATEGORIES)} + 1 AS place
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark) WHERE md5(w) < '1'),
pt AS (SELECT cluster, place, SUM({T.PROMPT_KEYWORDS + 1} - rank) AS points FROM top JOIN lex USING (keyword) WHERE rank <= {T.PROMPT_KEYWORDS} GROUP BY ALL),
po AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY points DESC, place) AS r, MAX(points) OVER (PARTITION BY cluster) AS best FROM pt),
ch AS (SELECT cluster, list({_CATS}[place] ORDER BY r) AS choice FROM po WHERE r <= {T.MAX_LABELS} AND 2 * points >= best GROUP BY cluster),
asked AS (SELECT kl.cluster, kl.keywords, coalesce(ch.choice, CAST([] AS VARCHAR[])) AS choice FROM kl LEFT JOIN ch ON ch.cluster = kl.cluster)"""


def _response(seed: str) -> str:
    h = f"md5(concat_ws(':', '{seed}', cluster, attempt))"
    chosen = "array_to_string(choice, ', ')"
    v = f"({Q.hexint(h, 1, 1)} % 8)"
    return f"""(CASE WHEN {v} <= 2 THEN '### Labels: ' || {chosen}
      WHEN {v} = 3 THEN '### Labels: ' || lower({chosen})
      WHEN {v} = 4 THEN {chosen}
      WHEN {v} = 5 THEN '### Labels: Nothing' || chr(10) || '### Labels: ' || {chosen}
      WHEN {v} = 6 THEN '### Labels: ' || {chosen} || chr(10)
      ELSE '' END)"""


def _parsed(resp: str) -> str:
    return f"list_transform(string_split(trim(string_split({resp}, '### Labels:')[-1], {_WS}), ','), lambda x: trim(x, {_WS}))"


def _valid(labels: str) -> str:
    return f"(len({labels}) > 0 AND len(list_filter({labels}, lambda x: NOT list_contains({_CATS}, x))) = 0)"


def _classified(seed: str) -> str:
    return f"""att_{seed} AS (
  SELECT cluster, keywords, attempt, {_parsed(_response(seed))} AS labels
  FROM asked, (SELECT unnest(range(1, {T.MAX_RETRY + 1})) AS attempt) a),
ok_{seed} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY attempt) AS r FROM att_{seed} WHERE {_valid('labels')}),
cls_{seed} AS (SELECT kl.cluster, kl.keywords, o.labels, o.attempt FROM kl LEFT JOIN ok_{seed} o ON o.cluster = kl.cluster AND o.r = 1)"""


_LAST = _asked_sql(FX.FIXTURE_CLUSTERS) + ",\n" + _classified("1") + ",\n" + _classified("2") + f""",
lines AS (SELECT 1 AS run, cluster, labels FROM cls_1 WHERE labels IS NOT NULL
          UNION ALL SELECT 2 AS run, cluster, labels FROM cls_2 WHERE labels IS NOT NULL),
last AS (SELECT cluster, labels FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY run DESC) AS r FROM lines) WHERE r = 1),
lab AS (SELECT cluster, list_sort(list_distinct(list_filter(labels, lambda x: list_contains({_CATS}, x)))) AS labels FROM last),
labelled AS (SELECT c.doc_id, c.text, c.cluster, coalesce(l.labels, CAST([] AS VARCHAR[])) AS labels
             FROM clustered c LEFT JOIN lab l ON l.cluster = c.cluster)"""

_DIST = """SUM((CAST(x.v AS DOUBLE) - c.v) * (CAST(x.v AS DOUBLE) - c.v))"""
_VEC = """vx AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
cent AS (SELECT label AS cluster, dim, AVG(CAST(v AS DOUBLE)) AS v FROM vx GROUP BY ALL),
d AS (SELECT x.vec_id, c.cluster, """ + _DIST + """ AS distance FROM vx x JOIN cent c ON c.dim = x.dim GROUP BY ALL),
asg AS (SELECT vec_id, cluster, distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM d) WHERE r = 1)"""

def _fit_sql() -> str:
    """First centroids, then one group of CTEs for each mini-batch."""
    parts = [f"""vx AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
share AS (SELECT least(1.0::DOUBLE, (COUNT(*) // 4)::DOUBLE / COUNT(*)) AS s FROM embeddings),
pick AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY md5(concat_ws(':', 'kmeans', vec_id)), vec_id) - 1 AS cluster FROM embeddings QUALIFY cluster < {FIT_CLUSTERS}),
c0 AS (SELECT cluster, 0 AS n, dim, v FROM pick JOIN vx USING (vec_id))"""]
    for t in range(1, FIT_STEPS + 1):
        parts.append(f"""b{t} AS (SELECT vx.* FROM vx, share WHERE ('0x' || substring(md5(concat_ws(':', 'kmeans', {t}, vec_id)), 1, 8))::BIGINT < ceil(s * 4294967296.0::DOUBLE)),
a{t} AS (SELECT vec_id, cluster FROM (SELECT x.vec_id, c.cluster, SUM((x.v - c.v) * (x.v - c.v)) AS d FROM b{t} x JOIN c{t - 1} c USING (dim) GROUP BY ALL)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1),
s{t} AS (SELECT cluster, dim, SUM(v) AS total, COUNT(*) AS m FROM a{t} JOIN vx USING (vec_id) GROUP BY ALL),
c{t} AS MATERIALIZED (SELECT c.cluster, c.n + coalesce(m, 0) AS n, c.dim, CASE WHEN m IS NULL THEN c.v ELSE (c.v * c.n + total) / (c.n + m) END AS v
        FROM c{t - 1} c LEFT JOIN s{t} s ON s.cluster = c.cluster AND s.dim = c.dim)""")
    return "WITH " + ",\n".join(parts)


ORACLE = {
    "kmeans_minibatch": _fit_sql() + f"""
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(n AS BIGINT) AS n, CAST(dim AS INTEGER) AS dim, round(v + 3.1e-12, 9) AS value FROM c{FIT_STEPS}""",
    "kmeans_fit": _fit_sql() + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM (SELECT x.vec_id, c.cluster, SUM((x.v - c.v) * (x.v - c.v)) AS d FROM vx x JOIN c{FIT_STEPS} c USING (dim) GROUP BY ALL)
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1""",
    "hashing_embed": f"""WITH w AS (
  SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM documents),
c AS (SELECT doc_id, {Q.hexint('md5(word)', 1, 8)} % {EMBED_BUCKETS} AS bucket, COUNT(*) AS n FROM w GROUP BY ALL),
e AS (SELECT doc_id, COUNT(*) AS n_nonzero, sqrt(SUM(n * n)::DOUBLE) AS norm, MAX(n) AS most, arg_max(bucket, (n, -bucket)) AS top FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_nonzero, 0) AS INTEGER) AS n_nonzero, CAST(coalesce(top, 0) AS INTEGER) AS top_bucket,
       coalesce(CAST(CAST(most / norm AS FLOAT) AS DOUBLE), 0.0) AS top_value
FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""",
    "keyword_normalise": f"WITH {Q.clustered_cte()}\nSELECT doc_id, cluster, {_CONTENTS} AS contents FROM clustered",
    "cluster_keywords": _KW + "\nSELECT cluster, CAST(rank AS INTEGER) AS rank, keyword, round(score + 3.1e-12, 9) AS score FROM top",
    "keyword_lists": _KW + "\nSELECT cluster, CAST(len(keywords) AS INTEGER) AS n_keywords, CAST(to_json(keywords) AS VARCHAR) AS keywords_json FROM kl",
    "topic_prompts": _KW + f"\nSELECT cluster, {_PROMPT} AS prompt FROM kl",
    "keyword_map_roundtrip": _KW + "\nSELECT cluster, CAST(rank AS INTEGER) AS rank, keyword FROM top",
    "topic_choice": _asked_sql(FX.SMALL_CLUSTERS) + "\nSELECT cluster, array_to_string(choice, '|') AS choice_str FROM asked",
    "parse_responses": _asked_sql(FX.FIXTURE_CLUSTERS) + ",\n" + _classified("1") + f"""
SELECT cluster, CAST(attempt AS INTEGER) AS attempt, array_to_string(labels, '|') AS labels_str, CAST({_valid('labels')} AS INTEGER) AS is_valid FROM att_1""",
    "topic_dead_letters": _asked_sql(FX.SMALL_CLUSTERS) + ",\n" + _classified("1") + """
SELECT CAST(cluster AS VARCHAR) AS cluster_id, CAST(len(keywords) AS INTEGER) AS n_keywords FROM cls_1 WHERE labels IS NULL""",
    "cluster_labels_last": _LAST + "\nSELECT cluster, array_to_string(labels, '|') AS labels_str FROM lab",
    "attach_topics": _LAST + "\nSELECT doc_id, cluster, array_to_string(labels, '|') AS labels_str FROM labelled",
    "label_vocabulary": _LAST + "\nSELECT label, COUNT(*) AS n_rows FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label",
    "noise_shuffle": _LAST + f""",
topic AS (SELECT label FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label ORDER BY COUNT(*) DESC, label LIMIT 1),
hit AS (SELECT *, coalesce(list_contains(labels, (SELECT label FROM topic)), false) AS noised FROM labelled)
SELECT doc_id, CAST(noised AS INTEGER) AS noised,
       CASE WHEN noised AND text <> '' THEN
         array_to_string(list_transform(list_sort(list_transform(string_split(text, ''),
             lambda ch, i: {{'k': substring(md5(concat_ws(':', 'noise', doc_id, (i - 1) // {NZ.PER_DIGEST})), CAST((i - 1) % {NZ.PER_DIGEST} * {NZ.DIGITS} + 1 AS INTEGER), {NZ.DIGITS}), 'i': i, 'c': ch}})), lambda s: s.c), '')
       ELSE text END AS text
FROM hit""",
    "kmeans_assign": "WITH " + _VEC + """
SELECT a.vec_id, e.label, CAST(a.cluster AS INTEGER) AS cluster, round(a.distance + 3.1e-12, 9) AS distance
FROM asg a JOIN embeddings e ON e.vec_id = a.vec_id""",
    "kmeans_lloyd_step": "WITH " + _VEC + """
SELECT CAST(a.cluster AS INTEGER) AS cluster, CAST(x.dim AS INTEGER) AS dim, round(AVG(CAST(x.v AS DOUBLE)) + 3.1e-12, 9) AS value
FROM vx x JOIN asg a ON a.vec_id = x.vec_id GROUP BY ALL""",
}
