"""Data checks beside and inside the main job (PF10) and metric snapshots (SK8).

Rules are named conditions that a row should meet; a null condition counts as broken. ``observed`` counts while
the rows pass through to whatever action reads them, ``violations`` lists the broken rows, and
``enforced`` fails the job at the first one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from topicweave.sources.io import append_metrics


def _broken(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(False))


def observed(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows as they are, and an observation that holds ``n_rows`` and one count of broken rows a rule once an action has
    run over them; no pass of its own."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(_broken(rule)).alias(name) for name, rule in rules.items()]]
    return df.observe(seen, *counts), seen


def violations(df: DataFrame, rules: Mapping[str, Column], key: Sequence[str]) -> DataFrame:
    """(rule, key...) of every broken row, one row a rule; a narrow pass."""
    broken = F.array_compact(F.array(*[F.when(_broken(rule), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), *key)


def enforced(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows as they are; reading a broken one fails the job with the names of its rules."""
    names = F.concat_ws(", ", *[F.when(_broken(rule), F.lit(name)) for name, rule in rules.items()])
    some = reduce(lambda a, b: a | b, (_broken(rule) for rule in rules.values()))
    stop = F.raise_error(F.concat(F.lit("broken rules: "), names)).cast("boolean")
    return df.where(F.when(some, stop).otherwise(F.lit(True)))


def log_metrics(spark: SparkSession, metrics: Mapping[str, float], step: int, path: str, every: int = 1) -> bool:
    """SK8: append (step, metric, value) rows at every ``every``-th step; whether this step was one."""
    if step % every:
        return False
    append_metrics(spark.createDataFrame([(step, name, float(value)) for name, value in metrics.items()], "step long, metric string, value double"), path)
    return True
