"""Keywords, response parsing, label resolution, attachment, noise, clustering."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from topicweave.operators import clustering as C
from topicweave.operators import keywords as K
from topicweave.operators import noise as NZ
from topicweave.operators import topics as T
from topicweave.sources import fixtures as FX


def _tfidf_model(texts, stops):
    """Per-cluster TF-IDF with smooth idf, raw tf, L2 rows, column sums (documented defaults)."""
    docs = []
    for t in texts:
        c = re.sub(r"\W+", " ", t.lower())
        c = " ".join(w for w in c.split() if w not in stops)
        if c.strip():
            docs.append(re.findall(r"(?u)\b\w\w+\b", c))
    n = len(docs)
    df = Counter()
    for d in docs:
        df.update(set(d))
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    score = defaultdict(float)
    for d in docs:
        tf = Counter(d)
        v = {w: tf[w] * idf[w] for w in tf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for w, x in v.items():
            score[w] += x / norm
    return score


def test_tfidf_matches_model(spark, sf_small):
    cl = FX.clustered_text(FX.table(spark, sf_small, "documents"), 3)
    stops = set(K.stop_words("english"))
    got = K.cluster_tfidf(cl, sorted(stops)).collect()
    by_cluster = defaultdict(dict)
    for r in got:
        by_cluster[r["cluster"]][r["term"]] = r["score"]
    texts = defaultdict(list)
    for r in cl.collect():
        texts[r["cluster"]].append(r["text"])
    for c, ts in texts.items():
        model = _tfidf_model(ts, stops)
        assert set(model) == set(by_cluster[c])
        for w, s in model.items():
            assert math.isclose(by_cluster[c][w], s, rel_tol=1e-9)


def test_parse_and_validate_edges(spark):
    rows = [
        (1, "### Labels: Science, Technology"),
        (2, "Science, History"),
        (3, "### Labels: Nothing\n### Labels: Law"),
        (4, "### Labels: Law\n"),
        (5, ""),
        (6, "### Labels: science"),
        (7, "### Labels: Law, Bogus"),
        (8, "### Labels:"),
    ]
    df = spark.createDataFrame(rows, "id int, response string")
    out = {r["id"]: (r["labels"], r["ok"]) for r in df.select(
        "id", T.parse_labels(F.col("response")).alias("labels"), T.labels_valid(T.parse_labels(F.col("response"))).alias("ok")).collect()}
    assert out[1] == (["Science", "Technology"], True)
    assert out[2] == (["Science", "History"], True)
    assert out[3] == (["Law"], True)
    assert out[4] == (["Law"], True)
    assert out[5] == ([""], False)
    assert out[6][1] is False
    assert out[7][1] is False
    assert out[8] == ([""], False)


def test_last_line_wins_and_whitelist(spark):
    lines = spark.createDataFrame([
        (1, '{"cluster_id": "3", "keywords": [], "labels": ["Law"]}'),
        (2, '{"cluster_id": "4", "keywords": [], "labels": ["Science", "Science", "Bogus"]}'),
        (3, "   "),
        (4, '{"cluster_id": "3", "keywords": [], "labels": ["History", "Time"]}'),
    ], "line_no int, value string")
    got = {r["cluster"]: r["labels"] for r in T.cluster_labels_last(lines).collect()}
    assert got == {3: ["History", "Time"], 4: ["Science"]}


def test_attach_keeps_every_row(spark, sf_small):
    cl = FX.clustered_text(FX.table(spark, sf_small, "documents"))
    labels = spark.createDataFrame([(0, ["Law"]), (1, ["Time"])], "cluster int, labels array<string>")
    out = T.attach_topics(cl, labels)
    assert out.count() == cl.count()
    assert out.where(F.col("labels").isNull()).count() == 0
    assert out.where("cluster = 5").select(F.size("labels")).distinct().collect()[0][0] == 0


def test_classify_with_python_responder(spark):
    prompts = spark.createDataFrame([(0, ["a"], "p0"), (1, ["b"], "p1")], "cluster int, keywords array<string>, prompt string")

    def respond(prompt, attempt):
        if prompt == "p0":
            return "### Labels: Law" if attempt == 2 else "### Labels: nope"
        raise RuntimeError("down")

    got = {r["cluster_id"]: (r["labels"], r["attempt"], r["is_valid"]) for r in T.classify_with(prompts, respond, 3).collect()}
    assert got["0"] == (["Law"], 2, True)
    assert got["1"] == (None, None, False)


def test_noise_is_permutation(spark):
    df = spark.createDataFrame([(1, "héllo 😀 wörld", ["Technology"]), (2, "keep me", ["Law"]), (3, "", ["Technology"])],
                               "doc_id long, text string, labels array<string>")
    out = {r["doc_id"]: r["text"] for r in NZ.inject_noise(df).collect()}
    assert sorted(out[1]) == sorted("héllo 😀 wörld") and out[1] != "héllo 😀 wörld"
    assert out[2] == "keep me"
    assert out[3] == ""


def test_assign_nearest_matches_bruteforce(spark, sf_small):
    v = FX.table(spark, sf_small, "embeddings")
    cents = C.centroids_by_label(v)
    got = {r["vec_id"]: r["cluster"] for r in C.assign_nearest(v, cents).collect()}
    cm = {r["cluster"]: r["centroid"] for r in cents.collect()}
    for r in v.limit(50).collect():
        d = {c: sum((a - b) ** 2 for a, b in zip(r["embedding"], m)) for c, m in cm.items()}
        assert got[r["vec_id"]] == min(d, key=lambda c: (d[c], c))


def test_fit_kmeans_assigns_every_row_to_its_nearest_center(spark, sf_small):
    v = FX.table(spark, sf_small, "embeddings")
    model, out = C.fit_kmeans(v, k=4, seed=0, max_iter=5)
    centers = [list(c) for c in model.clusterCenters()]
    assert len(centers) == 4
    rows = out.select("vec_id", "embedding", "cluster").collect()
    assert len(rows) == v.count() and len({r["vec_id"] for r in rows}) == len(rows)
    for r in rows[:50]:
        d = [sum((a - b) ** 2 for a, b in zip(r["embedding"], c)) for c in centers]
        assert d[r["cluster"]] <= min(d) + 1e-6


def test_assign_nearest_block_size_does_not_change_result(spark, sf_small):
    v = FX.table(spark, sf_small, "embeddings")
    cents = C.centroids_by_label(v)
    a = sorted(tuple(r) for r in C.assign_nearest(v, cents).select("vec_id", "cluster").collect())
    b = sorted(tuple(r) for r in C.assign_nearest(v, cents, block=7).select("vec_id", "cluster").collect())
    assert a == b and len(a) == v.count()


def test_assignment_in_parts_of_the_centroids(spark):
    v = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(200)], "vec_id long, embedding array<double>")
    cents = spark.createDataFrame([(c, [float(c // 2), 1.0]) for c in range(30)], "cluster int, centroid array<double>")  # equal ones in pairs
    whole = sorted(tuple(r) for r in C.assign_nearest(v, cents).collect())
    assert whole == sorted(tuple(r) for r in C.assign_nearest(v, cents, centroid_bytes=7 * 16).collect())
    assert all(c % 2 == 0 for _, c, _ in whole)
    assert C.assign_nearest(v, cents.limit(0)).count() == 0


def test_choice_by_keywords_equals_plain_python(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    lexicon = [(rng.choice(words), rng.choice(T.CATEGORIES[:6])) for _ in range(40)] + [("w1", "No_category"), ("w2", "Law"), ("w2", "Law")]
    lists = [(c, rng.sample(words, rng.choice([0, 3, 20, 55]))) for c in range(30)] + [(99, ["nothing", "known"])]
    got = {r.cluster: r.choice for r in T.choose_topics(
        spark.createDataFrame(lists, "cluster int, keywords array<string>"), spark.createDataFrame(lexicon, "keyword string, label string")).collect()}
    for cluster, keywords in lists:
        points = {}
        for rank, w in enumerate(keywords[:50], 1):
            for _, label in {x for x in lexicon if x[0] == w and x[1] in T.CATEGORIES}:
                points[label] = points.get(label, 0) + 51 - rank
        order = sorted(points, key=lambda x: (-points[x], T.CATEGORIES.index(x)))[:3]
        assert got[cluster] == [x for x in order if 2 * points[x] >= points[order[0]]]
    assert got[99] == []


def test_labels_change_only_with_the_meaning_of_the_keywords(spark):
    lexicon = spark.createDataFrame([("law", "Law"), ("court", "Law"), ("ball", "Sports")], "keyword string, label string")
    choice = lambda words: T.choose_topics(spark.createDataFrame([(0, words)], "cluster int, keywords array<string>"), lexicon).first().choice
    assert choice(["law", "x"]) == choice(["court", "y"]) == ["Law"]
    assert choice(["ball", "x"]) == ["Sports"]


def test_a_responder_that_always_fails_gives_dead_letters_after_all_tries(spark):
    def respond(prompt, attempt):
        if attempt % 2:
            raise RuntimeError("no answer")
        return "### Labels: Law, Nonsense"

    prompts = spark.createDataFrame([(0, ["a"], "p0"), (1, ["b"], "p1")], "cluster int, keywords array<string>, prompt string")
    got = T.classify_with(prompts, respond).collect()
    assert sorted((r.cluster_id, r.labels, r.attempt, r.is_valid) for r in got) == [("0", None, None, False), ("1", None, None, False)]
    native = T.classify_clusters(prompts, lambda c, a: F.lit("### Labels: Nonsense")).collect()
    assert [r.is_valid for r in native] == [False, False] and all(r.labels is None for r in native)


def test_native_and_python_responders_follow_one_rule(spark):
    replies = ["### Labels: Law", "Law, Life", "### Labels: Law ", "", "### Labels: x ### Labels: Law,Life\n", "### Labels: Law,", "### Labels: law"]
    prompts = spark.createDataFrame([(i, ["k"], r) for i, r in enumerate(replies)], "cluster int, keywords array<string>, prompt string")
    python = {r.cluster_id: (r.labels, r.is_valid) for r in T.classify_with(prompts, lambda prompt, attempt: prompt, 1).collect()}
    native = {r.cluster_id: (r.labels, r.is_valid) for r in T.classify_clusters(prompts, lambda c, a: F.col("prompt"), 1).collect()}
    assert python == native and sum(v for _, v in native.values()) >= 3


@pytest.mark.parametrize("text", ["", "a", "abcd", "abcde", "öl 日本 \U0001F600!", "x" * 100])
def test_shuffle_is_the_documented_sort(spark, text):
    key = lambda i: hashlib.md5(f"noise:7:{i // 4}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8]
    want = "".join(text[i] for i in sorted(range(len(text)), key=lambda i: (key(i), i)))
    df = spark.createDataFrame([(7, text, ["Law"]), (8, text, ["Life"]), (9, None, ["Law"])], "doc_id int, text string, labels array<string>")
    got = {r.doc_id: r.text for r in NZ.inject_noise(df, "Law").collect()}
    assert got == {7: want, 8: text, 9: None}
    assert {r.text for r in NZ.inject_noise(df, None).collect()} == {text, None}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_noise_reaches_rows_at_every_scale(spark, sf):
    from topicweave.plans import topic_plans as TP

    out = TP.q_noise_shuffle(spark, f"/root/testdata/{sf}")
    assert out.where("noised = 1").count() > 0


def _minibatch_model(vectors, k, share, steps):
    """Mini-batch k-means in plain Python, with the same draws."""
    h = lambda *x: hashlib.md5(":".join(map(str, ("kmeans", *x))).encode()).hexdigest()
    order = sorted(vectors, key=lambda i: (h(i), i))[:k]
    cents, seen = [list(vectors[i]) for i in order], [0] * k
    for t in range(1, steps + 1):
        batch = [i for i in vectors if share >= 1 or int(h(t, i)[:8], 16) < math.ceil(share * 16**8)]
        near = {i: min(range(k), key=lambda c: (sum((a - b) ** 2 for a, b in zip(vectors[i], cents[c])), c)) for i in batch}
        for c in range(k):
            mine = [vectors[i] for i in batch if near[i] == c]
            if mine:
                total = [sum(x) for x in zip(*mine)]
                cents[c] = [(v * seen[c] + s) / (seen[c] + len(mine)) for v, s in zip(cents[c], total)]
                seen[c] += len(mine)
    return cents, seen


@pytest.mark.parametrize("batch_size", [40, 1000])
def test_minibatch_kmeans_equals_plain_python(spark, batch_size):
    rng = random.Random(5)
    vectors = {i: [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1)] for i in range(120)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = {r.cluster: (r.n, r.centroid) for r in C.fit_minibatch(df, 4, batch_size, 3).collect()}
    cents, seen = _minibatch_model(vectors, 4, min(1.0, batch_size / 120), 3)
    assert {c: n for c, (n, _) in got.items()} == dict(enumerate(seen))
    assert all(abs(a - b) < 1e-9 for c in got for a, b in zip(got[c][1], cents[c]))
    still = C.fit_minibatch(df, 4, batch_size, 50, tolerance=1e9)  # stops after the first batch
    assert sum(r.n for r in still.collect()) == sum(_minibatch_model(vectors, 4, min(1.0, batch_size / 120), 1)[1])


def test_embed_with_a_users_encoder(spark):
    def load():
        calls = []

        def encode(texts):
            assert len(texts) <= 3
            calls.append(len(texts))
            return [[float(len(t)), float(len(calls))] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "ab " * i, "x") for i in range(10)] + [(20, None, "x"), (21, " \n", "x")], "doc_id int, text string, embedding_model string").coalesce(1)
    got = C.embed_texts(df, load, batch_size=3).collect()
    assert {r.doc_id: r.embedding[0] for r in got} == {i: 3.0 * i for i in range(1, 10)}  # blank texts are dropped
    assert sorted(r.embedding[1] for r in got) == sorted(float(k) for k in (1, 2, 3) for _ in range(3))  # loaded once, batches of 3
    cut = C.embed_texts(df, load, batch_size=3, max_pieces=2).collect()
    assert max(r.embedding[0] for r in cut) == 5.0


def test_hashing_embed_equals_plain_python(spark):
    texts = ["The cat, the CAT!", "", None, "éa b2_ b2_ b2_", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in C.hashing_embed(df, 16).collect():
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in re.findall(r"\w+", (r.text or "").lower()))
        norm = math.sqrt(sum(v * v for v in counts.values())) or 1.0
        assert r.embedding == pytest.approx([counts[j] / norm for j in range(16)])


def test_term_counts_and_hot_terms(spark, monkeypatch):
    rng = random.Random(2)
    lists = [[rng.choice(["a", "bb", "é", "日本", "zz"]) for _ in range(n)] for n in (0, 1, 5, 60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    for r in df.select("w", K.term_counts(F.col("w")).alias("t")).collect():
        assert [(x.term, x.tf) for x in r.t] == sorted(Counter(r.w).items(), key=lambda x: x[0].encode())
    texts = [" ".join(rng.choice(["the", "cat", "dog", f"w{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i % 7, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, cluster int")  # ids used more than once
    want = {(r.cluster, r.term): r.score for r in K.cluster_tfidf(docs).collect()}
    monkeypatch.setattr(K, "HOT_TERMS", 3)
    few = {(r.cluster, r.term): r.score for r in K.cluster_tfidf(docs).collect()}
    assert few.keys() == want.keys() and all(math.isclose(few[k], want[k], rel_tol=1e-12) for k in want)
    model = _tfidf_model([t for i, t in enumerate(texts) if i % 2 == 0], [])
    assert all(math.isclose(want[0, k], v, rel_tol=1e-9) for k, v in model.items())


def test_the_keyword_job_with_and_without_stop_words(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", 0), (2, "the cat", 0), (3, None, 1)], "doc_id long, text string, cluster int")
    with_stops = {r.cluster: r.keywords for r in K.extract_keywords(docs, 5).collect()}
    assert set(with_stops[0]) == {"cat", "dog"} and with_stops[1] == []
    assert "the" in {r.cluster: r.keywords for r in K.extract_keywords(docs, 5, remove_stopwords=False).collect()}[0]


def test_row_terms_count_each_rows_words(spark):
    rows = [(1, 10, ["b", "the", "cat", "cat", ""]), (1, 11, ["the", ""]), (2, 12, ["x"]), (2, 13, ["é1", "cat", "é1", "𝒳"]), (None, 14, ["cat"]), (2, 15, [])]
    df = spark.createDataFrame(rows, "cluster int, row long, words array<string>").coalesce(1)
    got = {(r.cluster, r.row): sorted((t.term, t.tf) for t in r.terms) for r in K.row_terms(df, ["the"]).collect()}
    assert got == {(1, 10): [("cat", 2)], (2, 12): [], (2, 13): [("cat", 1), ("é1", 2)], (None, 14): [("cat", 1)]}
    assert K.row_terms(df.limit(0)).count() == 0


def test_noise_sends_only_the_topics_texts_to_python(spark):
    df = spark.createDataFrame([(1, "abc 𝒳é", ["A"]), (2, "other", []), (None, "xyz", ["A"]), (4, None, ["A"])], "doc_id long, text string, labels array<string>")
    out = NZ.inject_noise(df, "A")
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    def model(prefix, t):
        key = lambda i: hashlib.md5(f"{prefix}{i // 4}".encode()).hexdigest()[i % 4 * 8 : i % 4 * 8 + 8]
        return "".join(t[i] for i in sorted(range(len(t)), key=lambda i: (key(i), i)))
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id != 4} == {1: model("noise:1:", "abc 𝒳é"), 2: "other", None: model("noise:", "xyz")}
