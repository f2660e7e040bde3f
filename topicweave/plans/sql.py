"""DuckDB spellings of the fixture adapters, shared by the oracle queries.

Each fragment is a CTE body with the same derivation as ``sources.fixtures``.
"""

from __future__ import annotations

TOK_SQL = r"'[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+'"


def u01(hex_expr: str, start: int = 1, digits: int = 8) -> str:
    """Uniform in [0,1) from hex digits of an md5 string (same as ``functions.hashing.hex_uniform``)."""
    return f"(CAST(('0x' || substring({hex_expr}, {start}, {digits})) AS BIGINT) / {float(16 ** digits)!r})"


def hexint(hex_expr: str, start: int, digits: int) -> str:
    return f"CAST(('0x' || substring({hex_expr}, {start}, {digits})) AS BIGINT)"


def md5key(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


CORPUS = """corpus AS (
  SELECT doc_id, text,
         (['books','code','ref','web'])[(CAST(substring(source, 4) AS INTEGER) % 4) + 1] AS category
  FROM documents)"""


def chunks_cte(chunk_len: int, src: str = "corpus") -> str:
    return f"""pieces AS (
  SELECT doc_id, category, regexp_extract_all(text, {TOK_SQL}) AS p FROM {src}),
chunk_starts AS (
  SELECT doc_id, category, p, unnest(range(0, len(p), {chunk_len})) AS s FROM pieces),
chunks AS (
  SELECT doc_id, category, CAST(s // {chunk_len} AS INTEGER) AS chunk_no,
         array_to_string(p[s + 1 : s + {chunk_len}], '') AS text,
         CAST(least({chunk_len}, len(p) - s) AS INTEGER) AS effective_tokens
  FROM chunk_starts)"""


def spec_cte(ratios: str) -> str:
    rows = []
    order = ["books", "code", "ref", "web"]
    parsed = dict(p.split(":") for p in ratios.split(","))
    for i, s in enumerate(order):
        rows.append(f"({i + 1}, '{s}', CAST({float(parsed.get(s, 0.0))!r} AS DOUBLE))")
    return "spec AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(ord, category, ratio))"


def quotas_cte(targets) -> str:
    """Quotas for targets in percent of all tokens."""
    tl = ", ".join(str(int(t)) for t in targets)
    return f"""totals AS (
  SELECT category, CAST(SUM(effective_tokens) AS BIGINT) AS total_tokens, COUNT(*) AS n_chunks
  FROM chunks GROUP BY category),
tgt AS (SELECT DISTINCT CAST(floor(coalesce((SELECT SUM(total_tokens) FROM totals), 0) * p / 100) AS BIGINT) AS target
        FROM (SELECT unnest([{tl}]) AS p)),
q0 AS (
  SELECT target, ord, s.category, ratio,
         CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens,
         CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks,
         CAST(floor(ratio * target) AS BIGINT) AS quota_tokens,
         CAST(CASE WHEN coalesce(total_tokens, 0) > 0
                   THEN floor(floor(ratio * target) / total_tokens * n_chunks) ELSE 0 END AS BIGINT) AS need
  FROM spec s LEFT JOIN totals t ON s.category = t.category, tgt),
q1 AS (
  SELECT *, SUM(need - n_chunks) OVER (PARTITION BY target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
  FROM q0),
q2 AS (
  SELECT *, CAST(x - least(0, MIN(x) OVER (PARTITION BY target ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS carry
  FROM q1),
quotas AS (
  SELECT target, ord, category, ratio, total_tokens, n_chunks, quota_tokens, need, carry,
         CAST(least(n_chunks, need + coalesce(LAG(carry) OVER (PARTITION BY target ORDER BY ord), 0)) AS BIGINT) AS take
  FROM q2)"""


def loss_log_cte(name: str = "loss_log") -> str:
    return LOSS_LOG_BODY.replace("@NAME@", name)


LOSS_LOG_BODY = """@NAME@ AS (
  SELECT CAST(floor(event_id / 32) + 1 AS BIGINT) AS step,
         CAST(event_id AS BIGINT) AS sample_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN CAST([] AS VARCHAR[])
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0
                THEN [event_type, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR)]
              ELSE [event_type] END AS labels,
         value / 100.0 AS loss
  FROM events)"""

LOSS_LOG = LOSS_LOG_BODY.replace("@NAME@", "loss_log")

VOCAB = """vocab AS (
  SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM loss_log UNION ALL SELECT 'never'))"""


def clustered_cte(n_clusters: int = 10) -> str:
    return f"""clustered AS (
  SELECT doc_id, text, CAST(doc_id % {n_clusters} AS INTEGER) AS cluster FROM documents)"""
