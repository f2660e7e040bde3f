"""Registered queries for evaluation metrics (AG10-AG14, FN1-FN9, ST10, ST11, WN2, JN2, SE3, SK7, PF9, PF10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.hashing import hex_int
from topicweave.functions.numeric import rounded
from topicweave.functions.ranking import global_row_number, quantile_buckets, with_line_index
from topicweave.operators import checks as CK
from topicweave.operators import evals as E
from topicweave.plans import sql as Q
from topicweave.plans.sequence_plans import TOKEN_SUMS_SQL, eval_token_sums
from topicweave.sources import fixtures as FX
from topicweave.sources.io import materialize


def _r(c, name=None):
    return rounded(F.col(c)).alias(name or c)


def _scored(spark, sf):
    items = FX.mcq_items(FX.table(spark, sf, "benchmark"))
    return E.score_options(FX.option_logits(E.mcq_prompts(items)))


def q_perplexity_by_subset(spark, sf):
    sums = eval_token_sums(spark, sf).withColumnsRenamed({"lang": "subset"})
    batch = F.floor(F.col("doc_id") / FX.EVAL_BATCH).cast("long").alias("batch_id")
    out = E.perplexity_by_subset(E.batch_losses(sums.withColumn("batch_id", batch), "subset", "batch_id"))
    return out.select("subset", "n_batches", _r("mean_loss"), _r("mean_acc"), _r("mean_ppl"))


def q_mcq_prompts(spark, sf):
    items = FX.mcq_items(FX.table(spark, sf, "benchmark"))
    return E.mcq_prompts(items).select("item_id", "correct_idx", "prompt")


def q_mcq_metrics(spark, sf):
    m = E.mcq_metrics(_scored(spark, sf))
    return m.select("total", "correct", _r("accuracy"), "low_confidence", _r("low_confidence_pct"),
                    *[_r(f"avg_prob_{x}") for x in "abcd"])


def q_running_accuracy(spark, sf):
    out = E.running_accuracy(_scored(spark, sf))
    return out.select("total", _r("running_accuracy"), "low_confidence_so_far")


def _pair_choices(spark, sf):
    bench = FX.table(spark, sf, "benchmark")  # line positions come from the file
    pairs = with_line_index(E.pair_scores(FX.pair_losses(FX.pair_items(bench))))
    labels = with_line_index(FX.pair_labels(bench).select("label"))
    return E.pair_choice(pairs, labels)


def q_pair_choice_accuracy(spark, sf):
    return E.pair_accuracy(_pair_choices(spark, sf)).select("total", "correct", _r("accuracy"), "n_ties")


def q_pair_inputs(spark, sf):
    return _pair_choices(spark, sf).select("item_id", "input1", "input2", _r("score1"), _r("score2"), "pred")


def _language_ids(spark, sf):
    return E.label_ids(FX.table(spark, sf, "documents"), "lang")


TASKS = ("cola", "language", "mnli", "mnli-mm", "mrpc")


def q_task_metrics(spark, sf):
    """AG13 + SE3 + FN3: each task by its own metrics, predictions from class scores."""
    scored = FX.task_scores(FX.table(spark, sf, "labels"), FX.table(spark, sf, "documents"), _language_ids(spark, sf))
    pred = scored.select("task", "label", E.predicted_class(F.col("scores")).alias("prediction"))
    return E.task_metrics(pred, TASKS).select("task", "metric", _r("value"))


def q_class_agreement(spark, sf):
    """AG13 for four classes: accuracy and the general Matthews coefficient of the predicted languages."""
    scored = FX.task_scores(FX.table(spark, sf, "labels"), FX.table(spark, sf, "documents"), _language_ids(spark, sf)).where("task = 'language'")
    pred = scored.select("label", E.predicted_class(F.col("scores")).alias("prediction"))
    return E.classification_metrics(pred, ("accuracy", "matthews_correlation")).select("metric", _r("value"))


def q_class_prediction_table(spark, sf):
    """FN3 + SK7: the languages' names by class scores, in document order."""
    ids = _language_ids(spark, sf)
    scored = FX.task_scores(FX.table(spark, sf, "labels"), FX.table(spark, sf, "documents"), ids).where("task = 'language'")
    at = global_row_number(quantile_buckets(scored, "doc_id", "_q"), [F.col("doc_id")], F.col("_q"), "_rn").withColumn("index", F.col("_rn") - 1)
    return E.class_prediction_rows(at, "index", F.col("scores"), ids)


def q_label_ids(spark, sf):
    return E.label_ids(FX.table(spark, sf, "labels"), "quality")


def q_classification_metrics(spark, sf):
    pred = FX.predictions(FX.table(spark, sf, "labels"))
    metrics = ("accuracy", "f1", "matthews_correlation")
    matched = E.classification_metrics(pred.where(F.pmod("doc_id", F.lit(2)) == 0), metrics)
    mism = E.classification_metrics(pred.where(F.pmod("doc_id", F.lit(2)) == 1), metrics, "_mm")
    return matched.unionByName(mism).select("metric", _r("value"))


def q_regression_metrics(spark, sf):
    r = E.regression_metrics(FX.regression_pairs(FX.table(spark, sf, "documents")))
    return r.select(_r("pearson"), _r("spearmanr"), _r("mse"), "n", _r("combined_score"))


def q_prediction_table(spark, sf):
    lab = FX.table(spark, sf, "labels").withColumn(
        "split", F.when(F.pmod("doc_id", F.lit(2)) == 0, "test_matched").otherwise("test_mismatched")
    )
    idx = global_row_number(quantile_buckets(lab, "doc_id", "_q"), [F.col("doc_id")], F.col("_q"), "_rn", ("split",))
    idx = idx.withColumn("index", F.col("_rn") - 1)
    value = F.pmod(hex_int(F.md5(F.col("doc_id").cast("string")), 1, 4), F.lit(5001)) / 1000.0
    return E.prediction_rows(idx, "index", value, True, keep=("split",))


def _document_rules():
    """What a document of the corpus should meet."""
    return {
        "n_chars_is_length": F.col("n_chars") == F.length("text"),
        "no_blank_ends": F.col("text") == F.trim("text"),
        "ends_a_sentence": F.col("text").rlike(r"[.!?]$"),
        "known_source": F.col("source").isNotNull(),
    }


def q_rule_violations(spark, sf):
    """PF10: the documents that break a rule."""
    return CK.violations(FX.table(spark, sf, "documents"), _document_rules(), ["doc_id"])


def q_data_checks(spark, sf):
    """PF10: counts over whole inputs - pairs without a label (the label file lacks every seventh), documents without labels
    and labels without a document - and the broken rules of the documents, observed while the first check reads them."""
    bench = FX.table(spark, sf, "benchmark")
    docs, seen = CK.observed(FX.table(spark, sf, "documents"), _document_rules())
    labels = FX.table(spark, sf, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")
    short = FX.pair_labels(bench).where(F.pmod("item_id", F.lit(7)) != 3)
    unlabelled = count(FX.pair_items(bench).join(short, "item_id", "left_anti"), "pair_without_label")
    with_row = docs.join(labels.distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    missing = materialize(with_row.groupBy().agg(F.count_if(F.col("known").isNull()).alias("n_violations")).select(F.lit("docs_without_label_row").alias("check"), "n_violations"), "data-check")
    rules = spark.createDataFrame([(f"rule_{name}", n) for name, n in seen.get.items() if name != "n_rows"], "check string, n_violations long")
    lost = count(labels.join(FX.table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti"), "label_rows_without_doc")
    return unlabelled.unionByName(missing).unionByName(lost).unionByName(rules)


def q_sentence_pair_columns(spark, sf):
    bench = FX.table(spark, sf, "benchmark")
    frame = FX.pair_items(bench).join(FX.pair_labels(bench), "item_id").select("goal", "sol1", "label")
    return E.select_pair(frame)


QUERIES = {
    "perplexity_by_subset": q_perplexity_by_subset,
    "mcq_prompts": q_mcq_prompts,
    "mcq_metrics": q_mcq_metrics,
    "running_accuracy": q_running_accuracy,
    "pair_choice_accuracy": q_pair_choice_accuracy,
    "pair_inputs": q_pair_inputs,
    "task_metrics": q_task_metrics,
    "class_agreement": q_class_agreement,
    "class_prediction_table": q_class_prediction_table,
    "label_ids": q_label_ids,
    "classification_metrics": q_classification_metrics,
    "regression_metrics": q_regression_metrics,
    "prediction_table": q_prediction_table,
    "data_checks": q_data_checks,
    "rule_violations": q_rule_violations,
    "sentence_pair_columns": q_sentence_pair_columns,
}

# ---------------------------------------------------------------- oracle SQL

_EVAL = TOKEN_SUMS_SQL + f""",
batches AS (SELECT lang AS subset, CAST(floor(doc_id / {FX.EVAL_BATCH}) AS BIGINT) AS batch_id, CAST(SUM(loss_sum) AS DOUBLE) / nullif(SUM(loss_targets), 0) AS loss,
                   SUM(n_targets) AS targets, SUM(n_correct) AS correct
            FROM sums JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL),
b2 AS (SELECT subset, loss, correct / nullif(targets, 0) AS acc, exp(loss) AS ppl FROM batches)"""

_ITEMS = """wl AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark),
wx AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM wl),
fw AS (SELECT item_id, w, MIN(pos) AS pos FROM wx GROUP BY ALL),
rk AS (SELECT item_id, w, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY pos) AS r FROM fw),
items AS (
  SELECT b.item_id, b.text AS support, 'Which word opens item ' || CAST(b.item_id AS VARCHAR) || '?' AS question,
         MAX(CASE WHEN r = 1 THEN w END) AS correct_answer, MAX(CASE WHEN r = 2 THEN w END) AS distractor1,
         MAX(CASE WHEN r = 3 THEN w END) AS distractor2, MAX(CASE WHEN r = 4 THEN w END) AS distractor3
  FROM benchmark b LEFT JOIN rk ON rk.item_id = b.item_id GROUP BY b.item_id, b.text),
opt AS (
  SELECT *, list_transform(list_sort(list_transform([correct_answer, distractor1, distractor2, distractor3],
             lambda o, i: {'k': md5(concat_ws(':', 'mcq', item_id, i - 1)), 'o': o})), lambda s: s.o) AS options
  FROM items),
mcq AS (SELECT *, CAST(list_position(options, correct_answer) - 1 AS INTEGER) AS correct_idx FROM opt)"""

_PROMPT = """'Context: ' || support || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Options:' || chr(10)
 || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4] || chr(10)
 || chr(10) || 'Answer: '"""

_LG = "md5(concat_ws(':', 'logit', item_id))"
_SCORED = _ITEMS + f""",
lg AS (SELECT *, [{', '.join(f'{Q.hexint(_LG, 2 * j + 1, 2)} / 32.0' for j in range(4))}] AS logits FROM mcq),
ex AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM lg),
pr AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM ex),
scored AS (SELECT *, list_max(probs) AS confidence, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred_idx FROM pr)"""

_PAIRS = """pw AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS ws FROM benchmark),
pairs AS (
  SELECT item_id,
         array_to_string(ws[1:CAST(floor(len(ws) / 2) AS INTEGER)], ' ') AS goal,
         array_to_string(ws[CAST(floor(len(ws) / 2) AS INTEGER) + 1:len(ws)], ' ') AS sol1,
         array_to_string(list_reverse(ws[CAST(floor(len(ws) / 2) AS INTEGER) + 1:len(ws)]), ' ') AS sol2,
         CAST(item_id % 2 AS INTEGER) AS label
  FROM pw),
inputs AS (SELECT *, goal || ' ' || sol1 AS input1, goal || ' ' || sol2 AS input2 FROM pairs),
scored_pairs AS (SELECT *, """ + ", ".join(f"-list_avg(list_transform(regexp_extract_all(input{j}, {Q.TOK_SQL})[2:{FX.PAIR_WINDOW}], lambda x: ((4 + {Q.hexint('md5(x)', 1, 15)}) % 13) / 4.0)) AS score{j}"
                                    for j in (1, 2)) + """ FROM inputs),
ch AS (SELECT *, CASE WHEN score2 > score1 THEN 1 ELSE 0 END AS pred FROM scored_pairs)"""

_PRED = """pred AS (
  SELECT doc_id, quality AS label,
         CASE WHEN substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '3' THEN 1 - quality ELSE quality END AS prediction
  FROM labels)"""


def _cls(where: str, suffix: str) -> str:
    return f"""(SELECT * FROM (
  SELECT CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM pred WHERE {where}) c,
  LATERAL (SELECT (tp + tn) / (tp + tn + fp + fn) AS acc,
                  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
                  CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) > 0
                       THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc) m,
  LATERAL (SELECT unnest([{{'metric': 'accuracy{suffix}', 'value': acc}}, {{'metric': 'f1{suffix}', 'value': f1}},
                          {{'metric': 'matthews_correlation{suffix}', 'value': mcc}},
                          {{'metric': 'combined_score{suffix}', 'value': (acc + f1 + mcc) / 3}}]) AS mm) u)"""


def _class_scores(task: str, label: str, classes: int) -> str:
    h = f"md5(concat_ws(':', 'scores', {task}, doc_id))"
    return "[" + ", ".join(f"({Q.hexint(h, j + 1, 1)} + CASE WHEN {label} = {j} THEN 9 ELSE 0 END) / 4.0" for j in range(classes)) + "]"


_NLI = "CASE WHEN doc_id % 2 = 0 THEN 'mnli' ELSE 'mnli-mm' END"
_TASKS = f"""lids AS (SELECT lang AS name, ROW_NUMBER() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
ts AS (
  SELECT {_NLI} AS task, doc_id, quality + toxic AS label, {_class_scores(_NLI, '(quality + toxic)', 3)} AS scores FROM labels
  UNION ALL SELECT 'cola', doc_id, quality, {_class_scores("'cola'", 'quality', 2)} FROM labels
  UNION ALL SELECT 'mrpc', doc_id, toxic, {_class_scores("'mrpc'", 'toxic', 2)} FROM labels
  UNION ALL SELECT 'language', doc_id, label, {_class_scores("'language'", 'label', 4)} FROM documents JOIN lids ON lids.name = documents.lang),
guess AS (SELECT task, doc_id, label, list_position(scores, list_max(scores)) - 1 AS prediction FROM ts WHERE label IS NOT NULL),
acc AS (SELECT task, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, COUNT(*)::DOUBLE AS s, SUM(CASE WHEN label = prediction THEN 1 ELSE 0 END)::DOUBLE AS c,
               SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, SUM(CASE WHEN (label = 1) <> (prediction = 1) THEN 1 ELSE 0 END)::DOUBLE AS off1 FROM guess GROUP BY task),
t AS (SELECT task, label AS k, COUNT(*)::DOUBLE AS t FROM guess GROUP BY ALL),
p AS (SELECT task, prediction AS k, COUNT(*)::DOUBLE AS p FROM guess GROUP BY ALL),
mg AS (SELECT task, SUM(coalesce(t, 0) * coalesce(p, 0)) AS tp2, SUM(coalesce(t, 0) ** 2) AS t2, SUM(coalesce(p, 0) ** 2) AS p2 FROM t FULL JOIN p USING (task, k) GROUP BY task),
mt AS (SELECT *, CASE WHEN tp + off1 > 0 THEN 2 * tp / (2 * tp + off1) ELSE 0 END AS f1,
              CASE WHEN (s * s - p2) * (s * s - t2) > 0 THEN (c * s - tp2) / sqrt((s * s - p2) * (s * s - t2)) ELSE 0 END AS mcc FROM acc JOIN mg USING (task))"""


_RULES = """broken AS (
  SELECT 'n_chars_is_length' AS rule, doc_id FROM documents WHERE NOT coalesce(n_chars = length(text), false)
  UNION ALL SELECT 'no_blank_ends', doc_id FROM documents WHERE NOT coalesce(text = trim(text, ' '), false)
  UNION ALL SELECT 'ends_a_sentence', doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '[.!?]$'), false)
  UNION ALL SELECT 'known_source', doc_id FROM documents WHERE source IS NULL)"""

ORACLE = {
    "task_metrics": f"WITH {_TASKS}" + """
SELECT task, 'accuracy' || CASE WHEN task = 'mnli-mm' THEN '_mm' ELSE '' END AS metric, round(accuracy + 3.1e-12, 9) AS value FROM mt WHERE task <> 'cola'
UNION ALL SELECT task, 'f1', round(f1 + 3.1e-12, 9) FROM mt WHERE task = 'mrpc'
UNION ALL SELECT task, 'combined_score', round((accuracy + f1) / 2 + 3.1e-12, 9) FROM mt WHERE task = 'mrpc'
UNION ALL SELECT task, 'matthews_correlation', round(mcc + 3.1e-12, 9) FROM mt WHERE task = 'cola'""",
    "class_agreement": f"WITH {_TASKS}" + """
SELECT 'accuracy' AS metric, round(accuracy + 3.1e-12, 9) AS value FROM mt WHERE task = 'language'
UNION ALL SELECT 'matthews_correlation', round(mcc + 3.1e-12, 9) FROM mt WHERE task = 'language'
UNION ALL SELECT 'combined_score', round((accuracy + mcc) / 2 + 3.1e-12, 9) FROM mt WHERE task = 'language'""",
    "class_prediction_table": f"WITH {_TASKS}" + """
SELECT ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS index, name AS prediction
FROM guess JOIN lids ON lids.label = guess.prediction WHERE task = 'language'""",
    "pair_inputs": "WITH " + _PAIRS + """
SELECT item_id, input1, input2, round(score1 + 3.1e-12, 9) AS score1, round(score2 + 3.1e-12, 9) AS score2, pred FROM ch""",
    "perplexity_by_subset": f"""WITH {_EVAL}
SELECT subset, COUNT(*) AS n_batches, round(AVG(loss) + 3.1e-12, 9) AS mean_loss, round(AVG(acc) + 3.1e-12, 9) AS mean_acc, round(AVG(ppl) + 3.1e-12, 9) AS mean_ppl
FROM b2 GROUP BY subset
UNION ALL
SELECT '__all__', COUNT(*), round(AVG(loss) + 3.1e-12, 9), round(AVG(acc) + 3.1e-12, 9), round(AVG(ppl) + 3.1e-12, 9) FROM b2""",
    "mcq_prompts": "WITH " + _ITEMS + f"\nSELECT item_id, correct_idx, {_PROMPT} AS prompt FROM mcq",
    "mcq_metrics": "WITH " + _SCORED + """
SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN pred_idx = correct_idx THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(AVG(CASE WHEN pred_idx = correct_idx THEN 1 ELSE 0 END) + 3.1e-12, 9) AS accuracy,
       CAST(SUM(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence,
       round(AVG(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) * 100 + 3.1e-12, 9) AS low_confidence_pct,
       round(AVG(probs[1]) + 3.1e-12, 9) AS avg_prob_a, round(AVG(probs[2]) + 3.1e-12, 9) AS avg_prob_b,
       round(AVG(probs[3]) + 3.1e-12, 9) AS avg_prob_c, round(AVG(probs[4]) + 3.1e-12, 9) AS avg_prob_d
FROM scored""",
    "running_accuracy": "WITH " + _SCORED + """,
run AS (
  SELECT ROW_NUMBER() OVER (ORDER BY item_id) AS total,
         SUM(CASE WHEN pred_idx = correct_idx THEN 1 ELSE 0 END) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         SUM(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo
  FROM scored)
SELECT total, round(c / total + 3.1e-12, 9) AS running_accuracy, CAST(lo AS BIGINT) AS low_confidence_so_far FROM run WHERE total % 10 = 0""",
    "pair_choice_accuracy": "WITH " + _PAIRS + """
SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(AVG(CASE WHEN pred = label THEN 1 ELSE 0 END) + 3.1e-12, 9) AS accuracy,
       CAST(SUM(CASE WHEN score1 = score2 THEN 1 ELSE 0 END) AS BIGINT) AS n_ties
FROM ch""",
    "label_ids": """
SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, COUNT(*) OVER () AS num_labels
FROM (SELECT DISTINCT CAST(quality AS VARCHAR) AS label FROM labels)""",
    "classification_metrics": f"""WITH {_PRED}
SELECT mm.metric AS metric, round(mm.value + 3.1e-12, 9) AS value FROM {_cls('doc_id % 2 = 0', '')}
UNION ALL
SELECT mm.metric AS metric, round(mm.value + 3.1e-12, 9) AS value FROM {_cls('doc_id % 2 = 1', '_mm')}""",
    "regression_metrics": """WITH rp AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS label, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS DOUBLE) AS prediction
  FROM documents),
rr AS (SELECT *, RANK() OVER (ORDER BY label) + (COUNT(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl,
              RANK() OVER (ORDER BY prediction) + (COUNT(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS rpd FROM rp)
SELECT round(corr(label, prediction) + 3.1e-12, 9) AS pearson, round(corr(rl, rpd) + 3.1e-12, 9) AS spearmanr,
       round(AVG((label - prediction) * (label - prediction)) + 3.1e-12, 9) AS mse, COUNT(*) AS n,
       round((corr(label, prediction) + corr(rl, rpd)) / 2 + 3.1e-12, 9) AS combined_score
FROM rr""",
    "prediction_table": f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'test_matched' ELSE 'test_mismatched' END AS split,
       ROW_NUMBER() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS index,
       printf('%.3f', ({Q.hexint("md5(CAST(doc_id AS VARCHAR))", 1, 4)} % 5001) / 1000.0) AS prediction
FROM labels""",
    "rule_violations": f"WITH {_RULES} SELECT rule, doc_id FROM broken",
    "data_checks": f"""WITH {_RULES}
SELECT 'pair_without_label' AS "check", COUNT(*) AS n_violations FROM benchmark WHERE item_id % 7 = 3
UNION ALL SELECT 'docs_without_label_row', COUNT(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'label_rows_without_doc', COUNT(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'rule_' || r.rule, COUNT(b.rule) FROM (SELECT unnest(['n_chars_is_length', 'no_blank_ends', 'ends_a_sentence', 'known_source']) AS rule) r
          LEFT JOIN broken b ON b.rule = r.rule GROUP BY r.rule""",
    "sentence_pair_columns": "WITH " + _PAIRS + "\nSELECT goal AS text_a, sol1 AS text_b, label FROM pairs",
}
