"""Readers and writers (SC1-SC10, SK1-SK9) with declared schemas.

Lineage is cut by writing a table into the shared folder named by ``spark.checkpoint.dir``
(``materialize``), never by local checkpoints, so an executor loss re-reads the table
instead of recomputing a long lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.functions.ranking import with_line_index
from topicweave.session import checkpoint_dir

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
KEYWORD_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SC2: columnar directory scan (pruned to ``columns``)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SK1: columnar directory sink."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_json_sources(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType = TEXT_SCHEMA) -> DataFrame:
    """SC1: one JSON(L) file per source, read with a schema, with a ``category`` column."""
    frames = [spark.read.schema(schema).json(p).withColumn("category", F.lit(src)) for src, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_splits(spark: SparkSession, train_dir: str, dev_json: str, test_json: str, schema: T.StructType = TEXT_SCHEMA) -> DataFrame:
    """SC3: columnar train split + JSON dev/test splits in one frame with a ``split`` column."""
    from topicweave.operators.sequences import split_union

    return split_union(spark.read.parquet(train_dir), spark.read.schema(schema).json(dev_json), spark.read.schema(schema).json(test_json))


def write_keyword_map(keyword_lists: DataFrame, path: str) -> None:
    """SK3: keywords as JSON rows (cluster, keywords) - one object per cluster, never one whole-file object."""
    keyword_lists.select(F.col("cluster").cast("string").alias("cluster"), "keywords").write.mode("overwrite").json(path)


def read_keyword_map(spark: SparkSession, path: str, whole_object: bool = False) -> DataFrame:
    """SC4: (cluster INT, rank INT, keyword) from JSON rows, or from a single JSON object file
    ``{cluster: [keywords]}`` when ``whole_object`` (one file, read whole by one task)."""
    if whole_object:
        m = spark.read.text(path, wholetext=True).select(F.from_json("value", KEYWORD_MAP).alias("m"))
        kv = m.select(F.explode("m").alias("cluster", "keywords"))
    else:
        kv = spark.read.schema("cluster string, keywords array<string>").json(path)
    return kv.select(F.col("cluster").cast("int").alias("cluster"), F.posexplode("keywords").alias("rank", "keyword")).withColumn(
        "rank", F.col("rank") + 1
    )


def write_label_lines(classified: DataFrame, path: str, errors_path: str) -> None:
    """SK4: valid (cluster_id, keywords, labels) rows appended as JSON lines; failures to a dead-letter sink."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("written_at")
    classified.where("is_valid").select("cluster_id", "keywords", "labels", stamp).write.mode("append").json(path)
    classified.where(~F.col("is_valid")).select("cluster_id", "keywords", stamp).write.mode("append").json(errors_path)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC5: raw JSON lines with an append order for last-wins resolution: the batch's write
    time (stamped by ``write_label_lines``), then the position over the files."""
    pos = with_line_index(spark.read.text(path), files=True)
    order = F.struct(F.coalesce(F.get_json_object("value", "$.written_at"), F.lit("")).alias("t"), "line_no")
    return pos.select(order.alias("line_no"), "value")


def read_pair_file(spark: SparkSession, jsonl: str, labels_txt: str) -> DataFrame:
    """SC6 + JN2: pair-choice items and a one-int-per-line label file zipped by line position.

    Either may be several files, taken in order of their paths. Items and labels that differ in
    number fail the job: the zip would pair the wrong lines.
    """
    items = with_line_index(spark.read.schema("goal string, sol1 string, sol2 string").json(jsonl), files=True)
    labels = with_line_index(spark.read.text(labels_txt), files=True).select("line_no", F.trim("value").cast("int").alias("label"))
    pairs = items.withColumn("_item", F.lit(True)).join(labels.withColumn("_label", F.lit(True)), "line_no", "full_outer")
    alone = F.col("_item").isNull() | F.col("_label").isNull()
    line = F.when(alone, F.raise_error(F.concat(F.lit("no partner for line "), F.col("line_no").cast("string"))).cast("bigint")).otherwise(F.col("line_no"))
    return pairs.withColumn("line_no", line).drop("_item", "_label")


def read_user_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """SC7: user CSV or JSON split files; every file must have the same extension. Numbers in CSV columns (labels) are
    read as numbers, which takes a second pass over the file; where splits differ in that, the wider type holds."""
    exts = {p.rsplit(".", 1)[-1] for p in paths.values()}
    if len(exts) != 1 or not exts <= {"csv", "json"}:
        raise ValueError(f"split files must share one extension, csv or json: {sorted(exts)}")
    ext = exts.pop()
    frames = []
    for split, p in paths.items():
        r = spark.read.option("header", True).option("inferSchema", True).csv(p) if ext == "csv" else spark.read.json(p)
        frames.append(r.withColumn("split", F.lit(split)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_dataset(spark: SparkSession, registry: Mapping[str, str], name: str, split: str | None = None) -> DataFrame:
    """SC8: named dataset from a local registry name -> parquet path (no network)."""
    df = spark.read.parquet(registry[name])
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def write_vocabulary(labelled: DataFrame, path: str) -> None:
    """SK5: the distinct label list as JSON rows."""
    labelled.select(F.explode("labels").alias("label")).distinct().write.mode("overwrite").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """SK8: append a metrics snapshot (e.g. every N steps)."""
    metrics.write.mode("append").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SC9: the distinct label list that ``write_vocabulary`` stored."""
    return spark.read.schema("label string").json(path).where("label is not null").distinct()


def write_state(weights: DataFrame, path: str) -> None:
    """SK9: the topic-state snapshot (weights, EMAs, stage, counts, carried sums) keyed by window.

    A window that is written again, by a job that was run again, replaces its own rows. A snapshot counts only once
    its ``_versions`` entry is there, which is written last: a job that dies in between leaves the one before.
    """
    weights.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(path)
    done = weights.sparkSession.read.parquet(path).agg(F.max(F.col("window_id").cast("long")).alias("version"))
    done.where("version is not null").write.mode("append").json(f"{path.rstrip('/')}/_versions")


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """SC10: the state of the newest committed version, one row per label with all its columns (None when nothing was
    committed yet). Labels without rows in that window come from the newest window that has them."""
    try:
        version = spark.read.schema("version long").json(f"{path.rstrip('/')}/_versions").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    s = spark.read.parquet(path).where(F.col("window_id").cast("long") <= version)
    rest = [c for c in s.columns if c not in ("label", "window_id")]
    last = s.groupBy("label").agg(F.max(F.struct(F.col("window_id").cast("long").alias("window_id"), *rest)).alias("s"))
    return last.select("label", "s.*")
