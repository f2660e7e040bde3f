"""Embedding clustering (CL1-CL3, JN6, JN3).

Nearest-centroid assignment is the hot loop at scale (rows x k x dim). It runs in
``mapInArrow`` as a block matrix product against the centroid matrix, which is broadcast in
parts of at most ``CENTROID_BYTES``: one narrow pass per part keeps the nearest centroid so
far. No cross join of rows with centroids is ever materialised.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.functions.hashing import hex_below, hex_int, md5_key
from topicweave.functions.text import is_non_blank, normalise_words, words
from topicweave.functions.tokens import token_pieces

# Bytes of the centroids that one pass broadcasts.
CENTROID_BYTES = 256 * 1024 * 1024
# Bytes of one (rows x k) distance block in a Python worker; rows per block follow from k.
BLOCK_BYTES = 64 * 1024 * 1024


def centroids_by_label(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(cluster, centroid ARRAY<DOUBLE>): the per-label mean vector.

    Whole vectors are averaged by MLlib's ``Summarizer`` (a partial + final aggregate of one
    vector per group), so rows are not exploded into one row per dimension.
    """
    return _group_means(vectors.select(F.col(label_col).cast("int").alias("cluster"), vec_col), "cluster", vec_col).withColumnRenamed(
        "_mean", "centroid"
    )


def _group_means(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, _mean ARRAY<DOUBLE>): per-group mean of an array column."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    feats = df.select(key, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    means = feats.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(key, vector_to_array("_m").alias("_mean"))


def _centroid_part(centroids: DataFrame, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and matrix of the centroids whose id is ``part`` modulo ``parts``."""
    rows = centroids.where(F.pmod("cluster", F.lit(parts)) == part).select("cluster", "centroid").collect()
    rows.sort(key=lambda r: r["cluster"])
    return np.array([r["cluster"] for r in rows], dtype=np.int64), np.array([r["centroid"] for r in rows], dtype=np.float64)


def _nearest_of_part(vectors: DataFrame, part: tuple[np.ndarray, np.ndarray], vec_col: str, block: int) -> DataFrame:
    """``vectors`` with (cluster, distance) brought up to date by the centroids of ``part``."""
    block = max(1, min(block, BLOCK_BYTES // (8 * len(part[0]))))
    bc = vectors.sparkSession.sparkContext.broadcast(part)
    names = vectors.columns

    def run(batches):
        cids, c = bc.value
        c_sq = (c * c).sum(axis=1)
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            x = rb.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, c.shape[1])
            best = rb.column("cluster").to_numpy().astype(np.int64)
            dist = rb.column("distance").to_numpy().copy()
            for s in range(0, n, block):
                xb = x[s:s + block]
                d2 = (xb * xb).sum(axis=1)[:, None] - 2.0 * (xb @ c.T) + c_sq[None, :]
                j = np.argmin(d2, axis=1)
                near = np.maximum(d2[np.arange(len(j)), j], 0.0)
                was, at = dist[s:s + block], best[s:s + block]
                closer = (near < was) | ((near == was) & (cids[j] < at))
                at[closer], was[closer] = cids[j][closer], near[closer]
            cols = dict(zip(names, rb.columns)) | {"cluster": pa.array(best.astype(np.int32)), "distance": pa.array(dist)}
            yield pa.RecordBatch.from_arrays([cols[k] for k in names], names=names)

    return vectors.mapInArrow(run, vectors.schema)


def assign_nearest(
    vectors: DataFrame,
    centroids: DataFrame,
    key_cols: tuple[str, ...] = ("vec_id",),
    vec_col: str = "embedding",
    block: int = 4096,
    centroid_bytes: int = CENTROID_BYTES,
) -> DataFrame:
    """CL3 / JN6: (key..., cluster, distance) of the nearest centroid (squared Euclidean; ties -> lowest id).

    ``key_cols`` are passed through (name the vector column among them to keep it), so nothing has
    to be joined back. Rows go through in blocks of at most ``block`` rows, fewer when k is large,
    so that a (rows x k) distance block stays within BLOCK_BYTES (k = 10,000 -> about 800 rows);
    centroids beyond ``centroid_bytes`` take further passes. Without centroids there are no rows.
    """
    from topicweave.sources.io import materialize

    centroids = materialize(centroids.select("cluster", "centroid"), "centroids")
    k, d = centroids.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    parts = max(1, -(-k * d * 8 // centroid_bytes))
    carried = list(dict.fromkeys([*key_cols, vec_col]))
    out = vectors.select(*carried, F.lit(2**31 - 1).alias("cluster"), F.lit(float("inf")).alias("distance"))
    for part in range(parts):
        found = _centroid_part(centroids, part, parts)
        if len(found[0]):
            out = _nearest_of_part(out, found, vec_col, block)
    return out.where(F.lit(k > 0)).select(*key_cols, "cluster", "distance")


def lloyd_step(vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """CL2 (one Lloyd iteration): assign, then the mean of each cluster's vectors per dimension."""
    assigned = assign_nearest(vectors, centroids, (vec_col,), vec_col)
    return _group_means(assigned, "cluster", vec_col).select("cluster", F.posexplode("_mean").alias("dim", "value"))


def fit_kmeans(
    vectors: DataFrame,
    k: int,
    seed: int = 0,
    max_iter: int = 20,
    vec_col: str = "embedding",
    sample_fraction: float | None = None,
    init_mode: str = "random",
):
    """CL2: MLlib k-means (fit on a sample when given), then assign every row with the model.

    ``init_mode="random"`` draws the k starting centroids from the data; MLlib's default
    ``"k-means||"`` runs k-means++ over about 2k x steps candidates on the driver, which for
    k = 10,000 and 1,024 dimensions is a large single-machine job.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.withColumn("_features", array_to_vector(F.col(vec_col).cast("array<double>")))
    train = feats.sample(fraction=sample_fraction, seed=seed) if sample_fraction else feats
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode=init_mode, featuresCol="_features", predictionCol="cluster").fit(train)
    return model, model.transform(feats).drop("_features")


def first_centroids(vectors: DataFrame, k: int, seed: str = "kmeans", key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(cluster, n, centroid): the ``k`` vectors of the lowest md5(seed, key), each seen 0 times (a bounded top-k)."""
    drawn = vectors.select(md5_key(seed, F.col(key)).alias("h"), F.col(key).alias("key"), F.col(vec_col).cast("array<double>").alias("centroid")).orderBy("h", "key").limit(k)
    return drawn.select((F.row_number().over(Window.orderBy("h", "key")) - 1).cast("int").alias("cluster"), F.lit(0).cast("bigint").alias("n"), "centroid")


def minibatch_of(vectors: DataFrame, step: int, share: float, seed: str = "kmeans", key: str = "vec_id") -> DataFrame:
    """The rows of one mini-batch: those whose md5(seed, step, key) falls below ``share``."""
    return vectors.where(hex_below(md5_key(seed, F.lit(step), F.col(key)), 1, share))


def minibatch_step(batch: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """CL2, one mini-batch: every centroid becomes the mean of all vectors it has been given so far, so the more it has
    seen the less a batch moves it. Centroids without a vector in the batch stay."""
    assigned = assign_nearest(batch, centroids, (vec_col,), vec_col)
    counts = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    sums = _group_means(assigned, "cluster", vec_col).join(counts, "cluster")
    # the old count has a name of its own: inside a lambda, "n" would mean the new column of this select
    j = centroids.withColumnRenamed("n", "before").join(sums, "cluster", "left")
    moved = F.zip_with("centroid", "_mean", lambda c, x: (c * F.col("before") + x * F.col("m")) / (F.col("before") + F.col("m")))
    return j.select("cluster", (F.col("before") + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("m").isNull(), F.col("centroid")).otherwise(moved).alias("centroid"))


def fit_minibatch(
    vectors: DataFrame, k: int, batch_size: int = 100_000, steps: int = 100, seed: str = "kmeans",
    key: str = "vec_id", vec_col: str = "embedding", tolerance: float = 0.0,
) -> DataFrame:
    """CL2: mini-batch k-means; (cluster, n, centroid) after ``steps`` batches of about ``batch_size`` rows, or once no
    centroid moves by more than ``tolerance`` (squared distance).

    Each step's centroids are a version of their own in the shared folder, so a lost executor costs one
    step; a step reads one batch's vectors and shuffles k partial sums. Vectors of different lengths fail the job.
    """
    from topicweave.sources.io import materialize

    share = min(1.0, batch_size / max(1, vectors.count()))
    now = materialize(first_centroids(vectors, k, seed, key, vec_col), "centroids-0")
    for step in range(1, steps + 1):
        after = materialize(minibatch_step(minibatch_of(vectors, step, share, seed, key), now, vec_col), f"centroids-{step}")
        was = now.select("cluster", F.col("centroid").alias("was"))
        gap = F.aggregate(F.zip_with("centroid", "was", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
        most = after.join(was, "cluster").agg(F.max(gap)).first()[0]
        now = after
        if most is None or most < tolerance:
            break
    return now


def embed_texts(
    df: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text",
    batch_size: int = 128, max_pieces: int | None = None,
) -> DataFrame:
    """CL1 with a user's encoder: the non-blank rows with ``embedding`` ARRAY<FLOAT>.

    ``load_encoder()`` is called once per Python worker task and returns a function from at most ``batch_size``
    texts to a (texts x dimensions) matrix. ``max_pieces`` cuts texts to their first pieces (None: whole
    texts; a model may cut for itself). The other columns pass through.
    """
    rows = df.where(is_non_blank(F.col(text_col)))
    if max_pieces is not None:
        rows = rows.withColumn("_cut", F.array_join(F.slice(token_pieces(F.col(text_col)), 1, max_pieces), ""))
    else:
        rows = rows.withColumn("_cut", F.col(text_col))
    names = df.columns

    def run(batches):
        encode = None
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                encode = encode or load_encoder()
                found = np.asarray(encode(part.column("_cut").to_pylist()), dtype=np.float32)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [vectors], names=[*names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def hashing_embed(df: DataFrame, num_features: int = 1024, text_col: str = "text") -> DataFrame:
    """CL1 default offline encoder: counts of the words' md5 buckets, L2-normalised, as ARRAY<FLOAT> (all 0 without words).

    Words become bucket numbers natively; Arrow batches turn them into dense vectors.
    """
    bucket = lambda w: (hex_int(F.md5(w), 1, 8) % num_features).cast("int")
    rows = df.withColumn("_buckets", F.transform(words(normalise_words(F.coalesce(F.col(text_col), F.lit("")))), bucket))
    names = df.columns

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                lists = part.column("_buckets")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                counts = np.bincount(owner * num_features + lists.flatten().to_numpy(zero_copy_only=False), minlength=part.num_rows * num_features).reshape(-1, num_features)
                norm = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                dense = (counts / np.where(norm > 0, norm, 1.0)).astype(np.float32)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), num_features).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [vectors], names=[*names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
