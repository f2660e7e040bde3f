"""Driver contract: entry runs, keys line up, and a sample of queries equals its oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from topicweave.plans import all_queries

TABLES = "events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["sample_by_budget", "topic_weights", "cluster_keywords", "mcq_metrics", "token_sequences", "regression_metrics"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"target", "category", "doc_id", "chunk_no", "text", "effective_tokens"}
    assert df.count() > 0


def test_keys_line_up():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert own_keys() == set(all_queries()) and set(q) >= own_keys()
    assert len(own_keys()) == 69


def own_keys():
    """The keys of this library's own operators, as text: a plan module that goes missing shows."""
    return set("""
    attach_topics batch_plan blank_filter chunk_tokens class_agreement class_prediction_table classification_metrics cluster_keywords
    cluster_labels_last data_checks dynamic_pad first_n_rows global_loss_window hashing_embed keyword_lists
    keyword_map_roundtrip keyword_normalise kmeans_assign kmeans_fit kmeans_lloyd_step kmeans_minibatch label_ids
    label_vocabulary loss_decrease_rate loss_ema mcq_metrics mcq_prompts missing_shards mlm_mask noise_shuffle
    pair_choice_accuracy pair_inputs pair_sequences parse_ratio_spec parse_responses peek_rows per_sample_loss
    perplexity_by_subset prediction_table rank_local_weights regression_metrics resume_weights rule_violations
    running_accuracy sample_by_budget sample_nested_targets sampling_quota_carry sentence_pair_columns
    sentence_permute shard_assign shift_right source_token_totals span_infill split_union step_from_microbatch task_metrics
    stream_attach_topics stream_late_rows stream_topic_loss stream_weights token_recount token_sequences topic_dead_letters
    topic_choice topic_loss_window topic_prompts topic_weights train_log weighted_batch_loss
    """.split())


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("key", SAMPLE)
def test_oracle_agrees(spark, sf_small, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = E.queries()[key](spark, sf_small)
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[key])
    b = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)
            else:
                assert u == v
