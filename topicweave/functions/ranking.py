"""Global ordering without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row into one task.
Here a coarse, order-preserving bucket splits the work: rows are counted per bucket
(a small table, at most ``#buckets`` rows), the bucket offsets are a running sum over that
small table, and the rank inside a bucket is a window partitioned by the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_offsets(df: DataFrame, bucket_col: str, partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """(partition_cols..., bucket, n, offset) where offset = rows in earlier buckets.

    The running sum runs over the per-bucket counts only, which are bounded by the
    number of buckets the caller chose (e.g. 65,536 for four md5 hex digits).
    """
    counts = df.groupBy(*partition_cols, bucket_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*partition_cols).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def global_row_number(
    df: DataFrame,
    order_cols: list[Column],
    bucket: Column,
    name: str = "rn",
    partition_cols: tuple[str, ...] = (),
) -> DataFrame:
    """1-based row number in ``order_cols`` order (within ``partition_cols``).

    ``bucket`` must be monotone in the order (a prefix of the sort key). Exact and equal
    to ``row_number() over (partition by partition_cols order by order_cols)``.
    """
    b = df.withColumn("_bucket", bucket)
    offs = bucket_offsets(b, "_bucket", partition_cols).drop("_n")
    w = Window.partitionBy(*partition_cols, "_bucket").orderBy(*order_cols)
    return (
        b.join(offs, [*partition_cols, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(w))
        .drop("_bucket", "_offset")
    )


def running_totals(
    df: DataFrame,
    order_cols: list[Column],
    bucket: Column,
    value_cols: list[str],
    partition_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Inclusive running sums of ``value_cols`` (plus a running row count ``_rows``) in global order.

    Same bucket scheme as ``global_row_number``: per-bucket totals -> offsets over the small
    bucket table -> a window inside each bucket.
    """
    b = df.withColumn("_bucket", bucket).withColumn("_one", F.lit(1))
    vals = [*value_cols, "_one"]
    tot = b.groupBy(*partition_cols, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in vals])
    w_off = Window.partitionBy(*partition_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*partition_cols, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in vals])
    w_in = Window.partitionBy(*partition_cols, "_bucket").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    j = b.join(offs, [*partition_cols, "_bucket"])
    out = j
    for c in vals:
        name = "_rows" if c == "_one" else f"cum_{c}"
        out = out.withColumn(name, F.col(f"_o_{c}") + F.sum(c).over(w_in))
    return out.drop("_bucket", "_one", *[f"_o_{c}" for c in vals])


def quantile_buckets(df: DataFrame, col: str, name: str = "_bucket", n_buckets: int = 1024) -> DataFrame:
    """``df`` with a bucket number that rises with the numeric column ``col`` and holds about as many rows as any other,
    however the values are spread: at most ``n_buckets`` - 1 quantile bounds, met by binary search. Null and
    NaN have a bucket of their own, the last."""
    from pyspark.ml.feature import Bucketizer

    value = df.withColumn(f"{name}_v", F.col(col).cast("double"))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sorted({b for b in value.approxQuantile(f"{name}_v", probs, 1.0 / (4 * n_buckets)) if b == b})
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=f"{name}_v", outputCol=name, handleInvalid="keep").transform(value).drop(f"{name}_v")


def average_ranks(df: DataFrame, col: str, out: str, n_buckets: int = 1024) -> DataFrame:
    """Average (1-based) rank of ``col`` with ties sharing the mean rank, without a global sort task.

    Values are first reduced to (value, count) - a hot value becomes one row - then bucketed
    by approximate quantile boundaries (at most ``n_buckets`` - 1 numbers, like a model's
    parameters) with a binary-search ``Bucketizer``, and ranked with bucket offsets. Rows get
    their value's rank through an equi-join on the value.
    """
    vc = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    bucketed = quantile_buckets(vc, col, "_b", n_buckets)
    rt = running_totals(bucketed, [F.col(col)], F.col("_b"), ["_cnt"])
    ranks = rt.select(col, (F.col("cum__cnt") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(ranks, col)


def with_line_index(df: DataFrame, name: str = "line_no", files: bool = False) -> DataFrame:
    """0-based consecutive position in the frame's current order (e.g. lines of a file).

    ``monotonically_increasing_id`` keeps the order inside a scan partition but is not consecutive;
    its upper bits are the partition index, which serves as the bucket for consecutive numbering.
    Scan partitions are packed by size, not by name: for a frame read straight from files,
    ``files`` orders by (file path, place of the split in the file, position in the split), so that
    the lines of part-00000 come before those of part-00001.
    """
    m = df.withColumn("_mono", F.monotonically_increasing_id())
    bucket = F.shiftright("_mono", 33)
    if files:
        m = m.withColumn("_split", F.struct("_metadata.file_path", "_metadata.file_block_start"))
        bucket = F.col("_split")
    g = global_row_number(m, [F.col("_mono")], bucket, "_rn")
    return g.withColumn(name, F.col("_rn") - 1).drop("_mono", "_rn", "_split")
