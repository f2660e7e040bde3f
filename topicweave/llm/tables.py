"""Tables that an operator writes between its steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a scratch folder, allowed on local masters only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicweave-llm-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written once and read back: a lineage cut that outlives executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **own) -> DataFrame:
    """(row, ...): all columns of ``df`` as one struct, beside the columns an operator works on, so that no name of
    a user's column can meet a name of the operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(df: DataFrame, names: list[str], **replaced) -> DataFrame:
    """The columns ``names`` of the struct ``row`` again, some of them replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("row")[c]).alias(c) for c in names])


def text_key(text="text"):
    """What tells texts apart in a join (null counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that are never learned from: crc32 of the id as text, modulo 5, is 0 (null id: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
