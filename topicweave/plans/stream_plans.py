"""Registered streaming queries: each runs its stream to completion (availableNow) and returns
the sink table, which must equal the batch operator's result (same oracle SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.numeric import rounded
from topicweave.plans import reweight_plans as RP
from topicweave.plans import sql as Q
from topicweave.plans import topic_plans as TP
from topicweave.sources import fixtures as FX
from topicweave.sources.io import materialize
from topicweave.streaming import loss_stream as LS

N_RANGES = 7


def _feed(spark, df, order, name):
    """A file stream that replays ``df`` by ranges of ``order``."""
    src = LS.scratch(spark, name)
    files = LS.write_in_order(df, src, order, N_RANGES)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{src}/*")


def _run_windows(spark, sf, name, weights):
    """The hard log's feed through the stream, with the end-of-feed flush; the folder of its tables."""
    hard = materialize(FX.hard_loss_log(FX.table(spark, sf, "events"), RP.N), "hard-log")
    stream = _feed(spark, hard, "arrival", f"{name}-feed")
    out = LS.scratch(spark, name)
    windows = LS.Windows(out, RP.N, vocab=FX.loss_vocabulary(hard) if weights else None, switch_after=RP.SWITCH)
    LS.run_windows(stream, windows, out + "-ckpt").awaitTermination()
    windows.flush(spark)
    return out


def q_stream_topic_loss(spark, sf):
    """SR1 on a log with a full last window, a window of zero losses and late rows."""
    res = LS.read_stream_table(spark, _run_windows(spark, sf, "topic-loss", False), "closed")
    return res.select("label", "window_id", rounded("loss_sum").alias("loss_sum"), "sample_count")


def q_stream_late_rows(spark, sf):
    """The side output of SR1: rows that came after their window was closed."""
    return LS.read_stream_table(spark, _run_windows(spark, sf, "late-rows", False), "late").select("sample_id", "step", "window_id")


def q_stream_weights(spark, sf):
    """SR2 on the same log."""
    return RP._weights_out(LS.read_stream_table(spark, _run_windows(spark, sf, "weights", True), "weights"))


def q_stream_attach_topics(spark, sf):
    clustered = FX.clustered_text(FX.table(spark, sf, "documents"))
    stream = _feed(spark, clustered, "doc_id", "docs-feed")
    labels = TP._labels_last(spark, sf)
    out = LS.scratch(spark, "labelled")
    q = (LS.attach_topics_stream(stream, labels).select("doc_id", "cluster", "labels").writeStream
         .outputMode("append").format("parquet").option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "cluster", F.array_join("labels", "|").alias("labels_str"))


QUERIES = {
    "stream_topic_loss": q_stream_topic_loss,
    "stream_late_rows": q_stream_late_rows,
    "stream_weights": q_stream_weights,
    "stream_attach_topics": q_stream_attach_topics,
}

_WINDOW = f"CAST(ceil(step / {float(RP.N)}) AS BIGINT)"
_LATE = f"sample_id % {FX.LATE_EVERY} = 0 AND 2 * {_WINDOW} <= n"
_RAW = f"""{Q.loss_log_cte('raw_log')},
full_windows AS (SELECT CAST(floor(MAX(step) / {float(RP.N)}) AS BIGINT) AS n FROM raw_log)"""
# what the batch operators see: the log without the rows that come after their window was closed
_ON_TIME = f"""{_RAW},
loss_log AS (SELECT step, sample_id, labels, CASE WHEN {_WINDOW} = {FX.ZERO_WINDOW} THEN 0.0 ELSE loss END AS loss
             FROM raw_log, full_windows WHERE step <= n * {RP.N} AND NOT ({_LATE}))"""

ORACLE = {
    "stream_topic_loss": RP.ORACLE["topic_loss_window"].replace(Q.LOSS_LOG, _ON_TIME),
    "stream_late_rows": f"""WITH {_RAW}
SELECT sample_id, step, {_WINDOW} AS window_id FROM raw_log, full_windows WHERE step <= n * {RP.N} AND {_LATE}""",
    "stream_weights": RP.ORACLE["topic_weights"].replace(Q.LOSS_LOG, _ON_TIME),
    "stream_attach_topics": TP.ORACLE["attach_topics"],
}
