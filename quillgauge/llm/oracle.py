"""The same results in SQL for DuckDB, where SQL can say them."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || doc_id), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS whole, sum(w) OVER () AS weights FROM s
), b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps_before, weights - coalesce(sum(w) OVER o, 0) AS rest
  FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, caps_before + ratio * rest <= whole AS stops FROM b
), l AS (SELECT arg_min((whole - caps_before) / rest, ratio) FILTER (NOT stops) AS level FROM c
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap ELSE least(level * w, cap) END::DOUBLE AS target FROM c, l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t
), q AS (
  SELECT *, target - copies * source_size AS need,
         CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS f FROM p
), k AS (
  SELECT d.doc_id, d.size, q.*, CASE WHEN f > 0 AND f < 1 THEN u / (1 - u) / (f / (1 - f)) END AS pos
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), z AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, pos IS NULL ORDER BY pos, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k
), e AS (
  SELECT *, pos IS NOT NULL AND max(CASE WHEN before + size / 2.0 > need THEN 1 ELSE 0 END) OVER (
    PARTITION BY source, pos IS NULL ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING) = 0 AS chosen FROM z
)
SELECT doc_id, size, source_size, target, CAST((copies + CASE WHEN chosen THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM e
"""


OP12 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(CAST(c AS DOUBLE)))), true)
), q AS (
  SELECT DISTINCT vec_id AS query_id, x AS qx FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.query_id, v.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, greatest(len(q.qx), len(v.x)) + 1),
                                               lambda i: coalesce(q.qx[i], 0) * coalesce(v.x[i], 0))), 0) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id IS DISTINCT FROM q.query_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE = {"op3_pareto_mix": OP3, "op12_exact_topk": OP12}
