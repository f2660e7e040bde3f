"""Registered queries for token-sequence preparation, batches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions.hashing import md5_key
from topicweave.functions.numeric import rounded
from topicweave.functions.text import is_non_blank
from topicweave.functions.tokens import token_pieces
from topicweave.operators import evals as E
from topicweave.operators import sequences as SQ
from topicweave.plans import sql as Q
from topicweave.sources import fixtures as FX

L = 64          # pieces of a chunk row
W = 2 * L       # width of a row with separators: nothing is cut
ROW = ("doc_id", "chunk_no")
PAIR_LEN = 32
BATCH = 32
EPOCHS = 2
SHARDS = 8
PERMUTE_RATIO = 0.5
DONE_SHARDS = [("train", 0), ("train", 3), ("dev", 1)]


def _docs(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return d.where(is_non_blank(F.col("text")))


def _token_rows(spark, sf):
    """Whole texts as rows of L ids."""
    return SQ.pad_sequences(SQ.hashed_chunks(_docs(spark, sf), L), L)


def _sentence_rows(spark, sf):
    return SQ.pad_sequences(SQ.hashed_chunks(_docs(spark, sf), L, sep_after_sentence=True), W)


def _j(c):
    return F.array_join(F.col(c), ",")


def q_token_sequences(spark, sf):
    t = _token_rows(spark, sf)
    return t.select(*ROW, "n_tokens", _j("input_ids").alias("ids_str"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attn_sum"), _j("labels").alias("labels_str"))


def q_pair_sequences(spark, sf):
    bench = FX.table(spark, sf, "benchmark")
    pairs = FX.pair_items(bench)
    ids_of = lambda c: F.transform(token_pieces(F.col(c)), SQ.hashed_id)
    ab = FX.pair_labels(bench).join(pairs.select("item_id", ids_of("goal").alias("ids_a"), ids_of("sol1").alias("ids_b")), "item_id")
    ids = E.label_ids(FX.pair_labels(bench))
    mapped = E.map_label_ids(ab, ids)
    return mapped.select(
        "item_id", F.size("ids_a").alias("len_a"), F.size("ids_b").alias("len_b"),
        F.array_join(SQ.truncate_pair(F.col("ids_a"), F.col("ids_b"), PAIR_LEN), ",").alias("ids_str"), "label_id",
    )


def q_mlm_mask(spark, sf):
    m = SQ.mlm_mask(_token_rows(spark, sf), SQ.HASHED_IDS, key=ROW)
    return m.select(*ROW, _j("mlm_input_ids").alias("ids_str"), _j("mlm_labels").alias("labels_str"),
                    F.size(F.filter("mlm_labels", lambda x: x != SQ.IGNORE)).alias("n_masked"))


def q_shift_right(spark, sf):
    t = _sentence_rows(spark, sf)
    return t.select(*ROW, F.array_join(SQ.shift_right(F.col("input_ids"), W), ",").alias("decoder_ids_str"))


def q_sentence_permute(spark, sf):
    t = SQ.permute_sentences(_sentence_rows(spark, sf), PERMUTE_RATIO, key=ROW)
    return t.select(*ROW, _j("permuted_ids").alias("ids_str"))


def q_span_infill(spark, sf):
    t = SQ.span_infill(_sentence_rows(spark, sf), key=ROW)
    return t.select(*ROW, _j("infill_input_ids").alias("ids_str"), _j("infill_labels").alias("labels_str"),
                    F.size(F.filter("infill_labels", lambda x: x != SQ.IGNORE)).alias("n_masked"),
                    F.size(F.filter("infill_input_ids", lambda x: x == SQ.MASK)).alias("n_spans"))


def q_dynamic_pad(spark, sf):
    t = SQ.hashed_chunks(_docs(spark, sf), L).withColumn("batch_id", F.floor(F.col("doc_id") / 16).cast("long"))
    return SQ.dynamic_pad(t, ("batch_id", "chunk_no")).select(*ROW, "batch_id", F.size("ids").alias("n_tokens"), "padded_len", _j("padded_ids").alias("ids_str"))


def eval_token_sums(spark, sf):
    """Token sums of every row of a whole text, with its language."""
    docs = FX.table(spark, sf, "documents").where(is_non_blank(F.col("text")))
    rows = SQ.pad_sequences(SQ.hashed_chunks(docs, L, ("doc_id", "lang")), L)
    return E.token_sums(FX.model_outputs(rows))


def q_per_sample_loss(spark, sf):
    """FN4 + PF6 + FN11 over token rows: shifted loss over all places, targets and hits without the ignored ones."""
    return eval_token_sums(spark, sf).select(*ROW, rounded(E.sample_loss()).alias("loss"), "loss_targets", "n_targets", "n_correct")


def q_batch_plan(spark, sf):
    return SQ.batch_plan(_docs(spark, sf).select("doc_id"), BATCH, EPOCHS)


def _splits(spark, sf):
    d = FX.corpus(FX.table(spark, sf, "documents"))
    h = F.substring(md5_key("split", F.col("doc_id")), 1, 1)
    train = d.where(h < "c")
    dev = d.where((h >= "c") & (h < "e")).select("doc_id", "text")
    test = d.where(h >= "e").select("doc_id", "text")
    return SQ.split_union(train, dev, test)


def q_split_union(spark, sf):
    u = _splits(spark, sf)
    return u.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("category").alias("n_with_category"),
        F.sum(F.length("text")).cast("long").alias("n_chars"),
    )


def q_missing_shards(spark, sf):
    done = spark.createDataFrame(DONE_SHARDS, "split string, shard int")
    return SQ.missing_shards(_splits(spark, sf).select("split", "doc_id"), done, SHARDS)


QUERIES = {
    "token_sequences": q_token_sequences,
    "pair_sequences": q_pair_sequences,
    "mlm_mask": q_mlm_mask,
    "shift_right": q_shift_right,
    "sentence_permute": q_sentence_permute,
    "span_infill": q_span_infill,
    "dynamic_pad": q_dynamic_pad,
    "per_sample_loss": q_per_sample_loss,
    "batch_plan": q_batch_plan,
    "split_union": q_split_union,
    "missing_shards": q_missing_shards,
}

# ---------------------------------------------------------------- oracle SQL

_NB = r"text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}]')"
_BASE = f"""docs AS (SELECT doc_id, text FROM documents WHERE {_NB})"""


def _id(x: str) -> str:
    return f"(4 + {Q.hexint(f'md5({x})', 1, 15)})"


def _zeros(n: str) -> str:
    return f"list_transform(range({n}), lambda z: CAST(0 AS BIGINT))"


_CHUNKS = _BASE + f""",
tk AS (SELECT doc_id, regexp_extract_all(text, {Q.TOK_SQL}) AS pc FROM docs),
ck AS (SELECT doc_id, pc, unnest(range(0, len(pc), {L})) AS s FROM tk),
ch AS (SELECT doc_id, CAST(s // {L} AS INTEGER) AS chunk_no, pc[s + 1 : s + {L}] AS pc FROM ck)"""

_IDROWS = _CHUNKS + f""",
ir AS (SELECT doc_id, chunk_no, list_transform(pc, lambda x: {_id('x')}) AS ids FROM ch)"""

_TOKROWS = _IDROWS + f""",
rows AS (SELECT doc_id, chunk_no, CAST(len(ids) AS INTEGER) AS n_tokens, list_concat(ids, {_zeros(f'{L} - len(ids)')}) AS input_ids FROM ir),
rows2 AS (SELECT *, list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels,
                 list_transform(range(1, {L} + 1), lambda i: CASE WHEN i <= n_tokens THEN 0 ELSE 1 END) AS special FROM rows)"""

_SENTROWS = _CHUNKS + f""",
si AS (SELECT doc_id, chunk_no, flatten(list_transform(pc, lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN [{_id('x')}, 2]
                                                                     ELSE [{_id('x')}] END)) AS ids FROM ch),
srows AS (SELECT doc_id, chunk_no, list_concat(ids, {_zeros(f'{W} - len(ids)')}) AS input_ids FROM si)"""


# token sums of a row: the label of place i meets the loss of the place before it
TOKEN_SUMS_SQL = _TOKROWS + f""",
sums AS (SELECT doc_id, chunk_no,
  list_sum(list_transform(range(2, {L} + 1), lambda i: CASE WHEN labels[i] = -100 THEN 0.0 ELSE (labels[i] % 13) / 4.0 END)) AS loss_sum,
  len(list_filter(labels[2:], lambda x: x <> -100)) AS loss_targets,
  len(list_filter(labels, lambda x: x <> -100)) AS n_targets,
  len(list_filter(labels, lambda x: x <> -100 AND x % 3 = 0)) AS n_correct FROM rows2)"""


def _u(h: str, start: int) -> str:
    return Q.u01(h, start, 8)


_MH = "md5(concat_ws(':', 'mlm', doc_id, chunk_no, i - 1))"

ORACLE = {
    "token_sequences": "WITH " + _TOKROWS + """
SELECT doc_id, chunk_no, n_tokens, array_to_string(input_ids, ',') AS ids_str, n_tokens AS attn_sum, array_to_string(labels, ',') AS labels_str FROM rows2""",
    "pair_sequences": f"""WITH pw AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS ws FROM benchmark),
pairs AS (SELECT item_id, array_to_string(ws[1:CAST(floor(len(ws) / 2) AS INTEGER)], ' ') AS goal,
                 array_to_string(ws[CAST(floor(len(ws) / 2) AS INTEGER) + 1:len(ws)], ' ') AS sol1,
                 CAST(item_id % 2 AS INTEGER) AS label FROM pw),
lids AS (SELECT label, CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
         FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS label FROM pairs)),
pi AS (SELECT item_id, label, list_transform(regexp_extract_all(goal, {Q.TOK_SQL}), lambda x: {_id('x')}) AS a,
              list_transform(regexp_extract_all(sol1, {Q.TOK_SQL}), lambda x: {_id('x')}) AS b FROM pairs),
tr AS (SELECT *, len(a) AS la, len(b) AS lb, greatest(len(a) + len(b) - {PAIR_LEN}, 0) AS r FROM pi),
tr2 AS (SELECT *, least(abs(la - lb), r) AS f, r - least(abs(la - lb), r) AS s FROM tr),
tr3 AS (SELECT *, CASE WHEN la > lb THEN f + s // 2 ELSE s // 2 END AS ca,
               CASE WHEN la > lb THEN s - s // 2 ELSE f + s - s // 2 END AS cb FROM tr2)
SELECT item_id, CAST(la AS INTEGER) AS len_a, CAST(lb AS INTEGER) AS len_b,
       array_to_string(list_concat(a[1:la - ca], b[1:lb - cb]), ',') AS ids_str, l.label_id
FROM tr3 JOIN lids l ON l.label = CAST(tr3.label AS VARCHAR)""",
    "mlm_mask": "WITH " + _TOKROWS + f""",
mm AS (SELECT doc_id, chunk_no, list_transform(input_ids, lambda x, i: {{
  'ch': special[i] = 0 AND {_u(_MH, 1)} < 0.15,
  'rep': {_u(_MH, 9)} < 0.8, 'rnd': {_u(_MH, 17)} < 0.5,
  'rid': CAST(floor({_u(_MH, 25)} * {SQ.HASHED_IDS}) AS BIGINT), 'x': x}}) AS t FROM rows2),
mo AS (SELECT doc_id, chunk_no,
  list_transform(t, lambda s: CASE WHEN s.ch AND s.rep THEN 3 WHEN s.ch AND s.rnd THEN s.rid ELSE s.x END) AS ids,
  list_transform(t, lambda s: CASE WHEN s.ch THEN s.x ELSE -100 END) AS labs FROM mm)
SELECT doc_id, chunk_no, array_to_string(ids, ',') AS ids_str, array_to_string(labs, ',') AS labels_str,
       CAST(len(list_filter(labs, lambda v: v <> -100)) AS INTEGER) AS n_masked FROM mo""",
    "shift_right": "WITH " + _SENTROWS + f""",
r1 AS (SELECT doc_id, chunk_no, list_concat([CAST(2 AS BIGINT)], input_ids[1:{W - 1}]) AS s FROM srows),
r2 AS (SELECT doc_id, chunk_no, list_transform(s, lambda x, i: CASE WHEN i = {W} AND x = 2 THEN 0 ELSE x END) AS s FROM r1),
r3 AS (SELECT doc_id, chunk_no, list_transform(s, lambda x, i: CASE WHEN i < {W} AND x = 2 AND s[i + 1] = 0 THEN 0 ELSE x END) AS s FROM r2)
SELECT doc_id, chunk_no, array_to_string(s, ',') AS decoder_ids_str FROM r3""",
    "sentence_permute": "WITH " + _SENTROWS + f""",
e1 AS (SELECT doc_id, chunk_no, input_ids AS ids,
              list_transform(list_filter(range(0, {W} - 1), lambda j: input_ids[j + 2] = 2 AND input_ids[j + 1] <> 2), lambda j: j + 2) AS ends
       FROM srows),
e2 AS (SELECT *, len(ends) AS ns, CAST(ceil(len(ends) * {PERMUTE_RATIO}) AS INTEGER) AS k FROM e1),
e3 AS (SELECT *, list_transform(list_sort(list_transform(range(0, ns), lambda j: {{'h': md5(concat_ws(':', 'perm', doc_id, chunk_no, 's', j)), 'j': j}})), lambda q: q.j)[1:k] AS subs,
              list_transform(list_sort(list_transform(range(0, k), lambda i: {{'h': md5(concat_ws(':', 'perm', doc_id, chunk_no, 'o', i)), 'i': i}})), lambda q: q.i) AS ord
       FROM e2),
e4 AS (SELECT *, list_transform(range(0, ns), lambda j: CASE WHEN list_contains(subs, j) THEN subs[ord[list_position(subs, j)] + 1] ELSE j END) AS ordering FROM e3),
e5 AS (SELECT *, CASE WHEN ns > 0 THEN list_concat(
          flatten(list_transform(ordering, lambda j: ids[(CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1 : ends[j + 1]])),
          CASE WHEN {W} > ends[ns] THEN ids[ends[ns] + 1 : {W}] ELSE [] END)
        ELSE ids END AS permuted FROM e4)
SELECT doc_id, chunk_no, array_to_string(permuted, ',') AS ids_str FROM e5""",
    "span_infill": "WITH " + _SENTROWS + f""",
pl AS (SELECT doc_id, chunk_no, unnest(range(0, {W})) AS i, unnest(input_ids) AS x FROM srows),
ordinary AS (SELECT doc_id, chunk_no, i, x, md5(concat_ws(':', 'infill', doc_id, chunk_no, i)) AS h FROM pl WHERE x NOT IN ({SQ.PAD}, {SQ.SEP})),
drawn AS (SELECT *, len(list_filter([{', '.join(f'{c:.17e}' for c in SQ.poisson_steps(3.0))}], lambda c: c <= {_u('h', 1)})) AS n,
                 CAST(ceil(COUNT(*) OVER (PARTITION BY doc_id, chunk_no) * 0.3::DOUBLE) AS BIGINT) AS budget FROM ordinary),
taken AS (SELECT *, least(n, budget - coalesce(SUM(n) OVER (PARTITION BY doc_id, chunk_no ORDER BY h, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS take FROM drawn),
cover AS (SELECT DISTINCT doc_id, chunk_no, unnest(range(i, i + CAST(take AS BIGINT))) AS i FROM taken WHERE take > 0),
marked AS (SELECT p.doc_id, p.chunk_no, p.i, p.x, c.i IS NOT NULL AND p.x NOT IN ({SQ.PAD}, {SQ.SEP}) AS hidden FROM pl p LEFT JOIN cover c ON c.doc_id = p.doc_id AND c.chunk_no = p.chunk_no AND c.i = p.i),
seen AS (SELECT *, coalesce(lag(hidden) OVER (PARTITION BY doc_id, chunk_no ORDER BY i), false) AS before FROM marked),
made AS (SELECT doc_id, chunk_no, list(CASE WHEN hidden THEN {SQ.MASK} ELSE x END ORDER BY i) FILTER (WHERE NOT (hidden AND before)) AS inputs,
                list(CASE WHEN hidden THEN x ELSE -100 END ORDER BY i) AS labels FROM seen GROUP BY ALL)
SELECT doc_id, chunk_no, array_to_string(list_concat(inputs, {_zeros(f'{W} - len(inputs)')}), ',') AS ids_str, array_to_string(labels, ',') AS labels_str,
       CAST(len(list_filter(labels, lambda v: v <> -100)) AS INTEGER) AS n_masked, CAST(len(list_filter(inputs, lambda v: v = {SQ.MASK})) AS INTEGER) AS n_spans FROM made""",
    "dynamic_pad": "WITH " + _IDROWS + f""",
pl AS (SELECT *, CAST(floor(doc_id / 16) AS BIGINT) AS batch_id,
              CAST(ceil(MAX(len(ids)) OVER (PARTITION BY CAST(floor(doc_id / 16) AS BIGINT), chunk_no) / 8.0) * 8 AS INTEGER) AS padded_len FROM ir)
SELECT doc_id, chunk_no, batch_id, CAST(len(ids) AS INTEGER) AS n_tokens, padded_len,
       array_to_string(list_concat(ids, {_zeros('padded_len - len(ids)')}), ',') AS ids_str FROM pl""",
    "per_sample_loss": "WITH " + TOKEN_SUMS_SQL + f"""
SELECT doc_id, chunk_no, round(loss_sum / {L - 1} + 3.1e-12, 9) AS loss, loss_targets, n_targets, n_correct FROM sums""",
    "batch_plan": f"""WITH docs AS (SELECT doc_id FROM documents WHERE {_NB}),
e AS (SELECT doc_id, CAST(unnest(range(0, {EPOCHS})) AS INTEGER) AS epoch FROM docs)
SELECT epoch, doc_id,
       CAST(floor((ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', 'batch', epoch, doc_id)), doc_id) - 1) / {BATCH}) AS BIGINT) AS batch_no
FROM e""",
    "split_union": f"""WITH {Q.CORPUS},
s AS (SELECT *, substring(md5(concat_ws(':', 'split', doc_id)), 1, 1) AS h FROM corpus)
SELECT CASE WHEN h < 'c' THEN 'train' WHEN h < 'e' THEN 'dev' ELSE 'test' END AS split,
       COUNT(*) AS n_rows, COUNT(CASE WHEN h < 'c' THEN category END) AS n_with_category,
       CAST(SUM(length(text)) AS BIGINT) AS n_chars
FROM s GROUP BY 1""",
    "missing_shards": f"""WITH {Q.CORPUS},
s AS (SELECT doc_id, CASE WHEN substring(md5(concat_ws(':', 'split', doc_id)), 1, 1) < 'c' THEN 'train'
                         WHEN substring(md5(concat_ws(':', 'split', doc_id)), 1, 1) < 'e' THEN 'dev' ELSE 'test' END AS split
      FROM corpus),
g AS (SELECT split, CAST(doc_id % {SHARDS} AS INTEGER) AS shard, COUNT(*) AS n_rows FROM s GROUP BY ALL),
done AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in DONE_SHARDS)}) t(split, shard))
SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.split = g.split AND d.shard = g.shard)""",
}
