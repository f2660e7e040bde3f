"""Registered queries: one Spark callable and (where SQL can express it) one DuckDB oracle per key."""

from __future__ import annotations

import importlib

_MODULES = (
    "topicweave.plans.corpus_plans",
    "topicweave.plans.reweight_plans",
    "topicweave.plans.topic_plans",
    "topicweave.plans.eval_plans",
    "topicweave.plans.sequence_plans",
    "topicweave.plans.stream_plans",
)


def _load():
    return [importlib.import_module(name) for name in _MODULES]


def all_queries() -> dict:
    out = {}
    for m in _load():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _load():
        out.update(m.ORACLE)
    return out
