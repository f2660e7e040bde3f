"""Streaming topic reweighting (SR1, SR2) and incremental labelling (SR3).

Each micro-batch of the loss log goes through ``foreachBatch``: its rows are reduced to (window, label) sums, added to
the sums of the windows that are still open, and the windows that are complete are closed in order. A window closes once a step
of more than ``delay`` steps beyond its end has been seen; ``flush`` closes a full last window when the feed
has ended. Rows of a closed window are late and go to a side table. Closed sums, weights, late rows and the state
(open windows, what a window of mean 0 carries, the last closed window, the newest step) are written under
``epoch=<id>`` with overwrite, and a batch starts from the newest epoch before its own, so a replayed
batch replaces its own output. With rows at most ``delay`` steps out of order, the closed windows and weights
are those of the batch operators. SR3 is a stream-static left join.

Folder layout below ``out``: ``closed`` (SR1), ``weights`` (SR2), ``late``, ``state``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from topicweave.operators import reweight as R
from topicweave.operators import topics as T
from topicweave.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


STATE = "kind string, window_id bigint, label string, loss_sum double, sample_count bigint"


def _epochs(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _newest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The rows of the newest epoch before ``before``; None at the start."""
    stored = _epochs(spark, path)
    if stored is None:
        return None
    newest = stored.where(F.col("epoch") < before).agg(F.max("epoch")).first()[0]  # from partition names
    return None if newest is None else stored.where(F.col("epoch") == newest)


def _write(df: DataFrame, out: str, table: str, epoch_id: int) -> DataFrame:
    path = f"{out.rstrip('/')}/{table}/epoch={epoch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Windows:
    """The open and closed windows of one feed: ``on_batch`` for ``foreachBatch``, ``flush`` at the end of the feed.

    With a vocabulary the closed windows are folded to weights as well (SR2); windows without labelled
    samples are folded too, with averages of 0, as in the batch operator.
    """

    def __init__(self, out: str, every: int, delay: int = 0, vocab: DataFrame | None = None, switch_after: int = 0, eval_every: int | None = None):
        self.out, self.every, self.delay, self.vocab = out.rstrip("/"), every, delay, vocab
        self.switch_after, self.eval_every = switch_after, eval_every

    def on_batch(self, batch: DataFrame, epoch_id: int) -> None:
        self._advance(batch.sparkSession, batch, epoch_id)

    def flush(self, spark: SparkSession) -> None:
        """Close every full window. The epoch is the one that the feed's next micro-batch would have, and that
        replaces it, if the feed goes on after all."""
        stored = _epochs(spark, f"{self.out}/state")
        if stored is not None:
            newest = stored.agg(F.max("epoch")).first()[0]
            self._advance(spark, None, newest + 1)

    def _advance(self, spark: SparkSession, batch: DataFrame | None, epoch_id: int) -> None:
        state = _newest(spark, f"{self.out}/state", epoch_id)
        state = spark.createDataFrame([], STATE) if state is None else state
        # one small row: the last closed window and the newest step
        meta = state.where("kind = 'meta'").agg(F.max("window_id"), F.max("sample_count")).first()
        done, newest = meta[0] or 0, meta[1] or 0
        sums = state.where("kind = 'open'").select("window_id", "label", "loss_sum", "sample_count")
        if batch is not None:
            rows = batch.withColumn("window_id", R.window_of(F.col("step"), self.every))
            newest = max(newest, rows.agg(F.max("step")).first()[0] or 0)
            _write(rows.where(F.col("window_id") <= done), self.out, "late", epoch_id)
            fresh = rows.where(F.col("window_id") > done).select("window_id", "loss", F.explode("labels").alias("label")).groupBy("window_id", "label").agg(
                F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("sample_count"))
            sums = sums.unionByName(fresh).groupBy("window_id", "label").agg(F.sum("loss_sum").alias("loss_sum"), F.sum("sample_count").alias("sample_count"))
        last = max(done, (newest if batch is None else newest - self.delay - 1) // self.every)
        sums = _write(sums, self.out, "sums", epoch_id)
        closed = _write(sums.where(F.col("window_id") <= last).select("label", "window_id", "loss_sum", "sample_count"), self.out, "closed", epoch_id)
        carry = state.where("kind = 'carry'").select("label", F.col("loss_sum").alias("carried_sum"), F.col("sample_count").alias("carried_count"))
        if self.vocab is not None and last > done:
            carry = self._fold(closed, carry, done, last, epoch_id)
        kept = [
            sums.where(F.col("window_id") > last).select(F.lit("open").alias("kind"), "window_id", "label", "loss_sum", "sample_count"),
            carry.select(F.lit("carry").alias("kind"), F.lit(last).cast("bigint").alias("window_id"), "label", F.col("carried_sum").alias("loss_sum"), F.col("carried_count").alias("sample_count")),
            spark.createDataFrame([("meta", last, None, None, newest)], STATE),
        ]
        _write(kept[0].unionByName(kept[1]).unionByName(kept[2]), self.out, "state", epoch_id)

    def _fold(self, closed: DataFrame, carry: DataFrame, done: int, last: int, epoch_id: int) -> DataFrame:
        """Weights after each of the windows done + 1 .. last; returns what the last one carries on."""
        spark = closed.sparkSession
        before = _newest(spark, f"{self.out}/weights", epoch_id)
        if before is not None:
            before = before.groupBy("label").agg(F.max(F.struct("window_id", "weight", "loss_ema")).alias("s")).select("label", "s.weight", "s.loss_ema")
        grid = self.vocab.select("label", F.explode(F.sequence(F.lit(done + 1).cast("long"), F.lit(last).cast("long"))).alias("window_id"))
        stats = _write(R.stats_from_aggregates(grid, closed, self.every, self.switch_after, self.eval_every, carry=carry), self.out, "stats", epoch_id)
        _write(R.fold_weights(stats, state=before), self.out, "weights", epoch_id)
        return stats.where((F.col("window_id") == last) & (F.col("carried_count") > 0)).select("label", "carried_sum", "carried_count")


def run_windows(loss_stream: DataFrame, windows: Windows, checkpoint: str, available_now: bool = True):
    """SR1 and SR2 as one query; returns the started StreamingQuery."""
    w = loss_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(windows.on_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_weight_stream(
    loss_stream: DataFrame,
    vocab: DataFrame,
    out_path: str,
    checkpoint: str,
    every: int,
    switch_after: int,
    eval_every: int | None = None,
    available_now: bool = True,
    delay: int = 0,
):
    """SR2: the weights of the windows as they close, below ``<out_path>/weights``."""
    return run_windows(loss_stream, Windows(out_path, every, delay, vocab, switch_after, eval_every), checkpoint, available_now)


def read_stream_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """What the epochs of a feed have written to ``closed``, ``weights`` or ``late``."""
    return spark.read.parquet(f"{out.rstrip('/')}/{table}").drop("epoch")


def attach_topics_stream(chunks: DataFrame, cluster_labels: DataFrame) -> DataFrame:
    """SR3: label new chunks as they arrive (stream-static left join, labels broadcast)."""
    return T.attach_topics(chunks, cluster_labels)


def write_in_order(df: DataFrame, path: str, order_col: str, n_ranges: int, files: int = 4) -> int:
    """Write ``df`` in ``n_ranges`` ranges of ``order_col`` with about the same number of rows, one after another, each by
    ``files`` tasks, so that a file source over ``path/*`` with ``maxFilesPerTrigger`` = the returned number replays
    one range a trigger (a feed for tests and replays). A range of few rows is written as one file, and
    then all are."""
    bounds = df.approxQuantile(order_col, [i / n_ranges for i in range(1, n_ranges)], 0.0005)
    cuts = sorted(set(bounds))
    place = F.lit(0)
    for c in cuts:
        place = place + (F.col(order_col) > c).cast("int")
    counts = {r["_range"]: r["n"] for r in df.groupBy(place.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.values(), default=0) < 50 * files:
        files = 1
    for i in sorted(counts):
        df.where(place == i).repartition(files).write.parquet(f"{path}/range={i:05d}")
    return files
