"""Registered queries for loss-driven topic reweighting over the loss log (WT*, WN3-WN5, AG7-AG9, AG15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.numeric import rounded
from topicweave.operators import reweight as R
from topicweave.plans import sql as Q
from topicweave.sources import fixtures as FX
from topicweave.sources.io import materialize, read_state, scratch_path, write_state

N = FX.LOSS_ADJUST_EVERY
SWITCH = FX.LOSS_SWITCH_AFTER
ACCUM = FX.GRAD_ACCUM
RESUME_AT = 15
RANKS = 6


def _log(spark, sf):
    """The loss log as the trainer would hand it over: a written table (derived from events once),
    which the grid, scalar subqueries and aggregates below each read."""
    return materialize(FX.loss_log(FX.table(spark, sf, "events")), "loss-log")


def _rd(c):
    return rounded(F.col(c)).alias(c)


def q_topic_loss_window(spark, sf):
    agg = R.topic_loss_window(_log(spark, sf), N)
    return agg.select("label", "window_id", _rd("loss_sum"), "sample_count")


def q_global_loss_window(spark, sf):
    log = _log(spark, sf)
    st = R.window_stats(log, FX.loss_vocabulary(log), N, SWITCH)
    return st.groupBy("window_id").agg(F.first("n_labels").alias("n_labels"), F.first("global_avg").alias("global_avg"),
                                       F.first("stage").alias("stage")).select("window_id", "n_labels", _rd("global_avg"), "stage")


def q_loss_ema(spark, sf):
    log = _log(spark, sf)
    st = R.window_stats(log, FX.loss_vocabulary(log), N, SWITCH)
    lab = R.fold_weights(st)
    g = R.global_ema(st)
    return lab.join(g, "window_id").select("label", "window_id", _rd("loss_avg"), _rd("loss_ema"), _rd("global_ema"))


_WCOLS = ("label", "window_id", "stage", "sample_count")


def _weights_out(df):
    return df.select(*_WCOLS, _rd("loss_avg"), _rd("global_avg"), _rd("weight"))


def q_topic_weights(spark, sf):
    log = _log(spark, sf)
    return _weights_out(R.topic_weights(log, FX.loss_vocabulary(log), N, SWITCH))


def q_resume_weights(spark, sf):
    """WT12: fold to window RESUME_AT and store the state (weights, EMAs, stage, counts, carried sums, global EMA); a second
    run reads the newest committed version and goes on from it: same table as the full fold."""
    log = _log(spark, sf)
    vocab = FX.loss_vocabulary(log)
    grid, agg = R.window_grid(log, vocab, N), materialize(R.topic_loss_window(log, N), "label-sums")
    none = spark.createDataFrame([], "label string, carried_sum double, carried_count long")
    path = scratch_path(spark, "weight-state")
    before = R.stats_from_aggregates(grid.where(F.col("window_id") <= RESUME_AT), agg, N, SWITCH, carry=none)
    first = R.fold_weights(before)
    carried = before.select("label", "window_id", "carried_sum", "carried_count")
    write_state(first.join(R.global_ema(before), "window_id").join(carried, ["label", "window_id"]), path)

    state = read_state(spark, path)
    after = R.stats_from_aggregates(grid.where(F.col("window_id") > state.agg(F.max("window_id")).scalar()), agg, N, SWITCH, carry=state)
    rest = R.fold_weights(after, state=state)
    stored = spark.read.parquet(path).withColumn("window_id", F.col("window_id").cast("long")).select(first.columns)
    return _weights_out(stored.unionByName(rest))


def q_rank_local_weights(spark, sf):
    """WT11: per-process state; rank = sample_id mod 6 as an extra group key."""
    log = _log(spark, sf).withColumn("rank", F.pmod("sample_id", F.lit(RANKS)).cast("int"))
    w = R.topic_weights(log, FX.loss_vocabulary(log), N, SWITCH, group_cols=["rank"])
    return w.select("rank", "label", "window_id", "sample_count", _rd("weight"))


def _sampled(spark, sf):
    log = _log(spark, sf)
    vocab = FX.loss_vocabulary(log)
    w = R.topic_weights(log, vocab, N, SWITCH)
    return R.sample_weights(log, w, vocab, N)


def q_weighted_batch_loss(spark, sf):
    out = R.weighted_batch_loss(_sampled(spark, sf), ACCUM)
    return out.select("step", "n_samples", _rd("weighted_loss"), _rd("mean_loss"))


def q_train_log(spark, sf):
    """AG15 + WT9: logged train loss at steps where step % log_every == 0 (log_every = N)."""
    out = R.weighted_batch_loss(_sampled(spark, sf), ACCUM)
    return out.where(F.pmod("step", F.lit(N)) == 0).select("step", rounded("weighted_loss").alias("train_loss"))


def q_loss_decrease_rate(spark, sf):
    ev = R.eval_losses(_log(spark, sf), N)
    out = R.loss_decrease_rate(ev, SWITCH)
    return out.select("eval_step", _rd("valid_loss"), _rd("decrease_rate"), "switches_stage")


def q_step_from_microbatch(spark, sf):
    mb = R.microbatch_steps(_log(spark, sf), FX.MICRO_BATCH, ACCUM)
    return mb.groupBy("opt_step").agg(
        F.countDistinct("micro_batch").alias("n_microbatches"),
        F.count(F.lit(1)).alias("n_samples"),
        rounded(F.avg("loss")).alias("mean_loss"),
    )


QUERIES = {
    "topic_loss_window": q_topic_loss_window,
    "global_loss_window": q_global_loss_window,
    "loss_ema": q_loss_ema,
    "topic_weights": q_topic_weights,
    "resume_weights": q_resume_weights,
    "rank_local_weights": q_rank_local_weights,
    "weighted_batch_loss": q_weighted_batch_loss,
    "train_log": q_train_log,
    "loss_decrease_rate": q_loss_decrease_rate,
    "step_from_microbatch": q_step_from_microbatch,
}

# ---------------------------------------------------------------- oracle SQL
_B = repr(1 - R.ALPHA)
_A = repr(R.ALPHA)
_S1 = R.first_stage1_step(SWITCH, N)


def _stats(group: str = "") -> str:
    """Grid, raw aggregate, zero-mean carry segments and averages; ``group`` is an extra key or ''."""
    g = f"{group}, " if group else ""
    gsel = f"l.{group}, " if group else ""
    pw = f"PARTITION BY {g}window_id"
    pl = f"PARTITION BY {g}label"
    groups = f", (SELECT DISTINCT {group} FROM loss_log) gg" if group else ""
    ggsel = f"gg.{group}, " if group else ""
    return f"""nw AS (SELECT CAST(floor(MAX(step) / {float(N)}) AS BIGINT) AS n FROM loss_log),
grid AS (SELECT {ggsel}v.label, CAST(w.window_id AS BIGINT) AS window_id
         FROM vocab v, nw, (SELECT unnest(range(1, (SELECT n FROM nw) + 1)) AS window_id) w{groups}),
lx AS (SELECT {gsel}CAST(ceil(l.step / {float(N)}) AS BIGINT) AS window_id, l.loss, unnest(l.labels) AS label
       FROM loss_log l WHERE ceil(l.step / {float(N)}) <= (SELECT n FROM nw)),
agg AS (SELECT {g}window_id, label, SUM(loss) AS loss_sum, COUNT(*) AS sample_count FROM lx GROUP BY ALL),
s0 AS (SELECT {('gr.' + group + ', ') if group else ''}gr.label, gr.window_id, coalesce(a.loss_sum, 0.0) AS loss_sum,
              CAST(coalesce(a.sample_count, 0) AS BIGINT) AS sample_count
       FROM grid gr LEFT JOIN agg a ON {('a.' + group + ' = gr.' + group + ' AND ') if group else ''}a.window_id = gr.window_id AND a.label = gr.label),
s1 AS (SELECT *, coalesce(AVG(CASE WHEN sample_count > 0 THEN loss_sum / sample_count END) OVER ({pw}), 0.0) AS g_raw FROM s0),
s2 AS (SELECT *, coalesce(SUM(CASE WHEN g_raw = 0 THEN 0 ELSE 1 END)
                   OVER ({pl} ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM s1),
s3 AS (SELECT *, SUM(loss_sum) OVER ({pl}, seg ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e_sum,
              CAST(SUM(sample_count) OVER ({pl}, seg ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e_cnt
       FROM s2),
s4 AS (SELECT *, CASE WHEN e_cnt > 0 THEN e_sum / e_cnt ELSE 0.0 END AS loss_avg FROM s3),
stats AS (SELECT {g}label, window_id, e_cnt AS sample_count, loss_avg,
                 coalesce(AVG(CASE WHEN e_cnt > 0 THEN loss_avg END) OVER ({pw}), 0.0) AS global_avg,
                 COUNT(CASE WHEN e_cnt > 0 THEN 1 END) OVER ({pw}) AS n_labels,
                 CAST(CASE WHEN window_id * {N} >= {_S1} THEN 1 ELSE 0 END AS INTEGER) AS stage
          FROM s4)"""


def _fold(group: str = "") -> str:
    g = f"{group}, " if group else ""
    init_src = f"(SELECT DISTINCT {group}, label FROM stats)" if group else "vocab"
    jg = f"s.{group} = r.{group} AND " if group else ""
    rsel = f"s.{group}, " if group else ""
    d = "(s.loss_avg - s.global_avg)"
    return f"""rec AS (
  SELECT {g}label, CAST(0 AS BIGINT) AS window_id, CAST(NULL AS INTEGER) AS stage, CAST(NULL AS BIGINT) AS sample_count,
         CAST(NULL AS DOUBLE) AS loss_avg, CAST(NULL AS DOUBLE) AS global_avg,
         CAST(1.0 AS DOUBLE) AS weight, CAST(0.0 AS DOUBLE) AS loss_ema
  FROM {init_src}
  UNION ALL
  SELECT {rsel}s.label, s.window_id, s.stage, s.sample_count, s.loss_avg, s.global_avg,
    CASE WHEN s.global_avg = 0 THEN r.weight
         WHEN s.stage = 0 THEN CASE WHEN {d} > 0 THEN least(r.weight * (CAST(1.0 AS DOUBLE) + {d} / s.global_avg), CAST(5.0 AS DOUBLE)) ELSE r.weight END
         ELSE CASE WHEN {d} > 0 THEN greatest(r.weight * (CAST(1.0 AS DOUBLE) - {d} / s.global_avg), CAST(0.1 AS DOUBLE))
                   ELSE least(r.weight * (CAST(1.0 AS DOUBLE) + abs({d} / s.global_avg)), CAST(5.0 AS DOUBLE)) END END,
    CASE WHEN r.loss_ema = 0 THEN s.loss_avg ELSE CAST({_A} AS DOUBLE) * r.loss_ema + CAST({_B} AS DOUBLE) * s.loss_avg END
  FROM rec r JOIN stats s ON {jg}s.label = r.label AND s.window_id = r.window_id + 1)"""


_HEAD = f"WITH RECURSIVE {Q.LOSS_LOG},\n{Q.VOCAB},\n"

_GEMA = f"""gw AS (SELECT DISTINCT window_id, global_avg FROM stats),
grec AS (
  SELECT CAST(0 AS BIGINT) AS window_id, CAST(0.0 AS DOUBLE) AS global_ema
  UNION ALL
  SELECT g.window_id, CASE WHEN r.global_ema = 0 THEN g.global_avg
                           ELSE CAST({_A} AS DOUBLE) * r.global_ema + CAST({_B} AS DOUBLE) * g.global_avg END
  FROM grec r JOIN gw g ON g.window_id = r.window_id + 1)"""

_WEIGHTS_SQL = _HEAD + _stats() + ",\n" + _fold() + """
SELECT label, window_id, stage, sample_count, round(loss_avg + 3.1e-12, 9) AS loss_avg, round(global_avg + 3.1e-12, 9) AS global_avg,
       round(weight + 3.1e-12, 9) AS weight
FROM rec WHERE window_id > 0"""

_SAMPLED = _HEAD + _stats() + ",\n" + _fold() + f""",
lw AS (SELECT step, sample_id, unnest(labels) AS label FROM loss_log),
sw AS (SELECT l.step, l.sample_id, AVG(r.weight) AS sample_weight
       FROM lw l JOIN rec r ON r.label = l.label AND r.window_id = CAST(ceil(l.step / {float(N)}) AS BIGINT) - 1
       GROUP BY l.step, l.sample_id),
per_step AS (
  SELECT l.step, COUNT(*) AS n_samples, AVG(l.loss * coalesce(sw.sample_weight, 0.0)) / {ACCUM} AS weighted_loss,
         AVG(l.loss) / {ACCUM} AS mean_loss
  FROM loss_log l LEFT JOIN sw ON sw.step = l.step AND sw.sample_id = l.sample_id GROUP BY l.step)"""

ORACLE = {
    "topic_loss_window": f"""WITH {Q.LOSS_LOG},
nw AS (SELECT CAST(floor(MAX(step) / {float(N)}) AS BIGINT) AS n FROM loss_log)
SELECT label, CAST(ceil(step / {float(N)}) AS BIGINT) AS window_id, round(SUM(loss) + 3.1e-12, 9) AS loss_sum, COUNT(*) AS sample_count
FROM (SELECT step, loss, unnest(labels) AS label FROM loss_log) x
WHERE ceil(step / {float(N)}) <= (SELECT n FROM nw)
GROUP BY 1, 2""",
    "global_loss_window": _HEAD + _stats() + """
SELECT DISTINCT window_id, n_labels, round(global_avg + 3.1e-12, 9) AS global_avg, stage FROM stats""",
    "loss_ema": _HEAD + _stats() + ",\n" + _fold() + ",\n" + _GEMA + """
SELECT r.label, r.window_id, round(r.loss_avg + 3.1e-12, 9) AS loss_avg, round(r.loss_ema + 3.1e-12, 9) AS loss_ema, round(g.global_ema + 3.1e-12, 9) AS global_ema
FROM rec r JOIN grec g ON g.window_id = r.window_id WHERE r.window_id > 0""",
    "topic_weights": _WEIGHTS_SQL,
    "resume_weights": _WEIGHTS_SQL,
    "rank_local_weights": f"WITH RECURSIVE {Q.loss_log_cte('loss_log0')},\n"
    + f"loss_log AS (SELECT *, CAST(sample_id % {RANKS} AS INTEGER) AS rank FROM loss_log0),\n"
    + Q.VOCAB + ",\n" + _stats("rank") + ",\n" + _fold("rank") + """
SELECT rank, label, window_id, sample_count, round(weight + 3.1e-12, 9) AS weight FROM rec WHERE window_id > 0""",
    "weighted_batch_loss": _SAMPLED + """
SELECT step, n_samples, round(weighted_loss + 3.1e-12, 9) AS weighted_loss, round(mean_loss + 3.1e-12, 9) AS mean_loss FROM per_step""",
    "train_log": _SAMPLED + f"""
SELECT step, round(weighted_loss + 3.1e-12, 9) AS train_loss FROM per_step WHERE step % {N} = 0""",
    "loss_decrease_rate": f"""WITH {Q.LOSS_LOG},
ev AS (SELECT CAST(ceil(step / {float(N)}) AS BIGINT) AS eval_no, AVG(loss) AS valid_loss FROM loss_log GROUP BY 1),
j AS (SELECT e.eval_no, e.eval_no * {N} AS eval_step, e.valid_loss, p.valid_loss AS prev
      FROM ev e LEFT JOIN ev p ON p.eval_no = e.eval_no - 1)
SELECT eval_step, round(valid_loss + 3.1e-12, 9) AS valid_loss, round((prev - valid_loss) / prev + 3.1e-12, 9) AS decrease_rate,
       CAST(CASE WHEN prev IS NOT NULL AND eval_step > {SWITCH} THEN 1 ELSE 0 END AS INTEGER) AS switches_stage
FROM j""",
    "step_from_microbatch": f"""WITH {Q.LOSS_LOG},
mb AS (SELECT *, CAST(floor(sample_id / {FX.MICRO_BATCH}) AS BIGINT) AS micro_batch FROM loss_log),
lim AS (SELECT floor(CAST(floor(MAX(sample_id) / {FX.MICRO_BATCH}) AS BIGINT) / {ACCUM}) + 1 AS max_steps FROM loss_log),
st AS (SELECT *, CAST(ceil(micro_batch / {float(ACCUM)}) + 1 AS BIGINT) AS opt_step FROM mb)
SELECT opt_step, COUNT(DISTINCT micro_batch) AS n_microbatches, COUNT(*) AS n_samples, round(AVG(loss) + 3.1e-12, 9) AS mean_loss
FROM st WHERE opt_step <= (SELECT max_steps FROM lim) GROUP BY opt_step""",
}
