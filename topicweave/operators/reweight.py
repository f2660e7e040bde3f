"""Loss-driven topic reweighting over a per-sample loss log (WT1-WT12, WN3-WN5, AG7-AG9).

Input ``loss_log``: (step LONG, sample_id LONG, labels ARRAY<STRING>, loss DOUBLE [, group cols]).

Plan shape: the only large input is the loss log. It is exploded by label and reduced by a
partial+final aggregate to (group, window, label) rows; everything after that works on the
vocabulary x window grid, whose size is set by the training configuration (labels x
steps/N), not by data volume. The weight recursion is a per-label ``aggregate()`` fold over
that label's windows (one small group per label), and the per-sample lookup joins the loss
log with one weight map per window (#windows rows, maps of at most #labels entries).

Semantics kept from the training loop:
* window_id = ceil(step / N); the incomplete last window never adjusts;
* labels of the vocabulary with no sample get average 0.0 and are adjusted, but do not
  enter the global mean (the mean of per-label averages over labels with samples);
* when the global mean is 0 the weights stay and the sums are not reset (counts carry into
  the next window; losses are assumed non-negative, as cross-entropy is);
* stage 0: above the mean, w = min(w * (1 + d/g), 5); stage 1: above, w = max(w * (1 - d/g), 0.1),
  else w = min(w * (1 + |d/g|), 5);
* the stage switches at the first evaluation after ``switch_after`` that is not the first
  evaluation; evaluation runs before adjustment at the same step;
* EMAs (alpha 0.9) replace instead of blend while they are exactly 0.0, and only get reported;
* the weights of window w apply to the samples of window w + 1; unlabelled samples weigh 0
  but stay in the mean's denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reweighting rule.
ALPHA = 0.9
MIN_WEIGHT = 0.1
MAX_WEIGHT = 5.0
INIT_WEIGHT = 1.0
FOLD_BLOCK = 256  # windows that are folded into one array before it joins the others

_REC = T.StructType([
    T.StructField("window_id", T.LongType()),
    T.StructField("stage", T.IntegerType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("loss_avg", T.DoubleType()),
    T.StructField("global_avg", T.DoubleType()),
    T.StructField("loss_ema", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])


def window_of(step: Column, every: int) -> Column:
    return F.ceil(step / F.lit(float(every))).cast("long")


def first_stage1_step(switch_after: int, eval_every: int) -> int:
    """First evaluation step strictly after ``switch_after`` that is not the first evaluation."""
    return max((switch_after // eval_every + 1) * eval_every, 2 * eval_every)


def topic_loss_window(loss_log: DataFrame, every: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """WT1 + AG7: per (group, window, label) loss sum and sample count over complete windows.

    A sample counts once for each of its labels (duplicates included, as in the loop).
    """
    n_windows = loss_log.agg(F.floor(F.max("step") / F.lit(float(every)))).scalar()
    log = loss_log.where(window_of(F.col("step"), every) <= n_windows)
    ex = log.select(*group_cols, window_of(F.col("step"), every).alias("window_id"), "loss", F.explode("labels").alias("label"))
    return ex.groupBy(*group_cols, "window_id", "label").agg(
        F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("sample_count")
    )


def window_grid(loss_log: DataFrame, vocab: DataFrame, every: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Vocabulary x complete windows (x groups), generated per vocabulary row; no cross join.

    The window count and the (few) group values are scalar subqueries over the loss log.
    """
    n_windows = loss_log.agg(F.floor(F.max("step") / F.lit(float(every))).cast("long")).scalar()
    wins = F.when(n_windows >= 1, F.sequence(F.lit(1).cast("long"), n_windows)).otherwise(F.array().cast("array<bigint>"))
    grid = vocab.select("label", F.explode(wins).alias("window_id"))
    if group_cols:
        groups = loss_log.agg(F.array_sort(F.collect_set(F.struct(*group_cols)))).scalar()
        grid = grid.select("label", "window_id", F.explode(groups).alias("_g")).select(
            *[F.col(f"_g.{c}").alias(c) for c in group_cols], "label", "window_id"
        )
    return grid


def window_stats(
    loss_log: DataFrame,
    vocab: DataFrame,
    every: int,
    switch_after: int,
    eval_every: int | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """WT2 + AG8 + WT5 + WT6: per (group, label, window) the averages the adjustment sees.

    Output: group..., label, window_id, sample_count, loss_avg, global_avg, n_labels, stage.
    """
    grid = window_grid(loss_log, vocab, every, group_cols)
    agg = topic_loss_window(loss_log, every, group_cols)
    return stats_from_aggregates(grid, agg, every, switch_after, eval_every, group_cols)


def stats_from_aggregates(
    grid: DataFrame,
    agg: DataFrame,
    every: int,
    switch_after: int,
    eval_every: int | None = None,
    group_cols: Sequence[str] = (),
    carry: DataFrame | None = None,
) -> DataFrame:
    """Window stats from a (group, window, label) grid and the per-label sums/counts (batch or stream).

    ``carry`` (group..., label, carried_sum, carried_count) holds what windows before the grid's first one left
    unadjusted because their global mean was 0; the result then has the same two columns, as they are after each window.
    """
    eval_every = eval_every or every
    keys = [*group_cols, "window_id", "label"]
    s = grid.join(agg, keys, "left").select(
        *keys,
        F.coalesce("loss_sum", F.lit(0.0)).alias("loss_sum"),
        F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"),
    )
    per_window = Window.partitionBy(*group_cols, "window_id")
    per_label = Window.partitionBy(*group_cols, "label").orderBy("window_id")
    raw_avg = F.when(F.col("sample_count") > 0, F.col("loss_sum") / F.col("sample_count"))
    s = s.withColumn("_g_raw", F.coalesce(F.avg(raw_avg).over(per_window), F.lit(0.0)))
    # windows whose global mean is 0 do not reset: they join the next window's segment
    closes = F.when(F.col("_g_raw") == 0, 0).otherwise(1)
    s = s.withColumn("_seg", F.coalesce(F.sum(closes).over(per_label.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = Window.partitionBy(*group_cols, "label", "_seg").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_sum", F.sum("loss_sum").over(seg)).withColumn("_cnt", F.sum("sample_count").over(seg).cast("long"))
    if carry is not None:
        first = F.col("_seg") == 0  # the segment that windows before the grid may have begun
        s = s.join(carry.select(*group_cols, "label", F.col("carried_sum").alias("_cs"), F.col("carried_count").alias("_cc")), [*group_cols, "label"], "left")
        s = s.withColumn("_sum", F.col("_sum") + F.when(first, F.coalesce("_cs", F.lit(0.0))).otherwise(F.lit(0.0)))
        s = s.withColumn("_cnt", F.col("_cnt") + F.when(first, F.coalesce("_cc", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("loss_avg", F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt")).otherwise(F.lit(0.0)))
    present = F.when(F.col("_cnt") > 0, F.col("loss_avg"))
    s = s.withColumn("global_avg", F.coalesce(F.avg(present).over(per_window), F.lit(0.0)))
    s = s.withColumn("n_labels", F.count(present).over(per_window))
    stage = F.when(F.col("window_id") * every >= first_stage1_step(switch_after, eval_every), 1).otherwise(0)
    kept = lambda c, zero: F.when(F.col("_g_raw") == 0, F.col(c)).otherwise(F.lit(zero))
    left = [] if carry is None else [kept("_sum", 0.0).alias("carried_sum"), kept("_cnt", 0).cast("long").alias("carried_count")]
    return s.select(
        *group_cols, "label", "window_id", F.col("_cnt").alias("sample_count"), "loss_avg", "global_avg",
        "n_labels", stage.cast("int").alias("stage"), *left,
    )


def _step(acc: Column, x: Column, min_w: float, max_w: float, alpha: float) -> Column:
    w, ema = acc["w"], acc["ema"]
    l, g = x["loss_avg"], x["global_avg"]
    d = l - g
    new_w = (
        F.when(g == 0, w)
        .when(x["stage"] == 0, F.when(d > 0, F.least(w * (F.lit(1.0) + d / g), F.lit(max_w))).otherwise(w))
        .otherwise(
            F.when(d > 0, F.greatest(w * (F.lit(1.0) - d / g), F.lit(min_w)))
            .otherwise(F.least(w * (F.lit(1.0) + F.abs(d / g)), F.lit(max_w)))
        )
    )
    new_ema = F.when(ema == 0, l).otherwise(F.lit(alpha) * ema + F.lit(1 - alpha) * l)
    rec = F.struct(
        x["window_id"].cast("long").alias("window_id"),
        x["stage"].cast("int").alias("stage"),
        x["sample_count"].cast("long").alias("sample_count"),
        l.cast("double").alias("loss_avg"),
        g.cast("double").alias("global_avg"),
        new_ema.cast("double").alias("loss_ema"),
        new_w.cast("double").alias("weight"),
    )
    return F.struct(new_w.cast("double").alias("w"), new_ema.cast("double").alias("ema"), F.concat(acc["out"], F.array(rec)).alias("out"))


def _blocks(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys..., _seq): each group's windows in order, as an array of blocks of ``FOLD_BLOCK`` windows."""
    block = F.floor(F.col("window_id") / FOLD_BLOCK).alias("_block")
    parts = rows.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_part"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_part"))).alias("_seq"))


def _fold_blocks(start: Column, step) -> Column:
    """``step`` folded over ``_seq``; the records it appends to ``out``, in order. An array that grows is copied by each
    step, so records join their block's array and only whole blocks the long one: work stays near the number of windows."""
    none = start["out"]
    names = lambda acc, out: F.struct(*[acc[c].alias(c) for c in start if c != "out"], out.alias("out"))

    def fold_block(acc, b):
        done = F.aggregate(b["_part"], names(acc, none), step)
        return F.get(F.transform(F.array(done), lambda d: names(d, F.concat(acc["out"], F.array(d["out"])))), F.lit(0))

    begin = F.struct(*[v.alias(c) for c, v in start.items() if c != "out"], F.slice(F.array(none), 1, 0).alias("out"))
    return F.flatten(F.aggregate("_seq", begin, fold_block)["out"])


def fold_weights(
    stats: DataFrame,
    group_cols: Sequence[str] = (),
    state: DataFrame | None = None,
    min_w: float = MIN_WEIGHT,
    max_w: float = MAX_WEIGHT,
    alpha: float = ALPHA,
) -> DataFrame:
    """WT3-WT7 + WN3 + WN5: per label, fold its windows in order to weights and loss EMA.

    ``state`` (optional; group..., label, weight, loss_ema) resumes from a stored snapshot
    (WT12): the fold starts from the stored weight and EMA instead of 1.0 / 0.0.
    Output: group..., label, window_id, stage, sample_count, loss_avg, global_avg, loss_ema, weight.
    """
    seq = _blocks(stats, [*group_cols, "label"], ["window_id", "stage", "sample_count", "loss_avg", "global_avg"])
    w0, e0 = F.lit(INIT_WEIGHT), F.lit(0.0)
    if state is not None:
        st = state.select(*group_cols, "label", F.col("weight").alias("_w0"), F.col("loss_ema").alias("_e0"))
        seq = seq.join(st, [*group_cols, "label"], "left")
        w0, e0 = F.coalesce("_w0", w0), F.coalesce("_e0", e0)
    init = {"w": w0.cast("double"), "ema": e0.cast("double"), "out": F.array().cast(T.ArrayType(_REC))}
    return seq.select(*group_cols, "label", F.inline(_fold_blocks(init, lambda acc, x: _step(acc, x, min_w, max_w, alpha))))


def global_ema(stats: DataFrame, group_cols: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """WN3 for the global mean: one fold per group over its windows."""
    per_win = stats.groupBy(*group_cols, "window_id").agg(F.first("global_avg").alias("global_avg"))
    seq = _blocks(per_win, group_cols, ["window_id", "global_avg"])
    rec_t = T.ArrayType(T.StructType([T.StructField("window_id", T.LongType()), T.StructField("global_ema", T.DoubleType())]))

    def step(acc, x):
        e = acc["e"]
        new = F.when(e == 0, x["global_avg"]).otherwise(F.lit(alpha) * e + F.lit(1 - alpha) * x["global_avg"]).cast("double")
        rec = F.struct(x["window_id"].cast("long").alias("window_id"), new.alias("global_ema"))
        return F.struct(new.alias("e"), F.concat(acc["out"], F.array(rec)).alias("out"))

    return seq.select(*group_cols, F.inline(_fold_blocks({"e": F.lit(0.0), "out": F.array().cast(rec_t)}, step)))


def topic_weights(
    loss_log: DataFrame,
    vocab: DataFrame,
    every: int,
    switch_after: int,
    eval_every: int | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """The whole batch reweighting: window stats then the per-label fold."""
    return fold_weights(window_stats(loss_log, vocab, every, switch_after, eval_every, group_cols), group_cols)


def initial_weights(loss_log: DataFrame, vocab: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """WT7: (group..., label, window_id = 0, weight = 1.0) for every vocabulary label."""
    init = vocab.select("label", F.lit(0).cast("long").alias("window_id"), F.lit(INIT_WEIGHT).alias("weight"))
    if group_cols:
        groups = loss_log.agg(F.array_sort(F.collect_set(F.struct(*group_cols)))).scalar()
        init = init.select("*", F.explode(groups).alias("_g")).select(
            *[F.col(f"_g.{c}").alias(c) for c in group_cols], "label", "window_id", "weight"
        )
    return init


def sample_weights(
    loss_log: DataFrame,
    weights: DataFrame,
    vocab: DataFrame,
    every: int,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """WT8 + JN4 + FN7: each sample's weight = mean weight of its labels after the previous window.

    Window 1 uses the initial weights. Unlabelled samples (or labels outside the vocabulary) weigh 0.
    """
    init = initial_weights(loss_log, vocab, group_cols)
    maps = weights.select(*group_cols, "label", "window_id", "weight").unionByName(init)
    maps = maps.groupBy(*group_cols, "window_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("_wmap")
    ).withColumnRenamed("window_id", "_prev")
    log = loss_log.withColumn("_prev", window_of(F.col("step"), every) - 1)
    j = log.join(maps, [*group_cols, "_prev"], "left")
    wmap = F.col("_wmap")
    found = F.filter(F.transform("labels", lambda lab: F.element_at(wmap, lab)), lambda x: x.isNotNull())
    w = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, b: a + b) / F.size(found)).otherwise(F.lit(0.0))
    return j.withColumn("sample_weight", F.coalesce(w, F.lit(0.0))).drop("_wmap", "_prev")


def weighted_batch_loss(sampled: DataFrame, grad_accum: int = 1) -> DataFrame:
    """AG9: per step mean(loss * weight) over all samples (unlabelled included), / grad_accum."""
    return sampled.groupBy("step").agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.avg(F.col("loss") * F.col("sample_weight")) / grad_accum).alias("weighted_loss"),
        (F.avg("loss") / grad_accum).alias("mean_loss"),
    )


def eval_losses(loss_log: DataFrame, eval_every: int) -> DataFrame:
    """Validation loss per evaluation step (mean loss of the steps since the previous evaluation)."""
    return loss_log.groupBy(window_of(F.col("step"), eval_every).alias("eval_no")).agg(F.avg("loss").alias("valid_loss")).withColumn(
        "eval_step", F.col("eval_no") * eval_every
    )


def loss_decrease_rate(evals: DataFrame, switch_after: int) -> DataFrame:
    """WN4 + WT5: (prev - cur) / prev against the previous evaluation, and the stage it sets.

    The previous evaluation is found by an equi-join on eval_no - 1 (no global window).
    """
    prev = evals.select((F.col("eval_no") + 1).alias("eval_no"), F.col("valid_loss").alias("_prev"))
    j = evals.join(prev, "eval_no", "left")
    # a previous loss of 0 counts as not yet set
    prev_loss = F.nullif(F.col("_prev"), F.lit(0.0))
    rate = (prev_loss - F.col("valid_loss")) / prev_loss
    switched = prev_loss.isNotNull() & (F.col("eval_step") > switch_after)
    return j.select("eval_no", "eval_step", "valid_loss", rate.alias("decrease_rate"), switched.cast("int").alias("switches_stage"))


def microbatch_steps(log: DataFrame, micro_batch: int, grad_accum: int) -> DataFrame:
    """WT10: micro-batch m (0-based) belongs to optimiser step ceil(m / accum) + 1.

    The first step has one micro-batch; micro-batches after the last one that fires never reach a step.
    """
    m = F.floor(F.col("sample_id") / micro_batch).cast("long")
    n_micro = log.agg((F.max("sample_id") / micro_batch).cast("long") + 1).scalar()
    max_steps = F.floor((n_micro - 1) / F.lit(grad_accum)) + 1  # micro-batch m fires a step when m % accum == 0
    step = (F.ceil(m / F.lit(float(grad_accum))) + 1).cast("long")
    return log.withColumn("micro_batch", m).withColumn("opt_step", step).where(F.col("opt_step") <= max_steps)
