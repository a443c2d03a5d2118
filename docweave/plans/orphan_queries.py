"""Queries of problem 6 over document_relation, document_node and document_metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.orphans import document_references, orphan_report
from docweave.runtime import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return document_references(
        table(spark, folder, "document_metadata").select("so_hieu", "created_at", "deleted_at"),
        table(spark, folder, "document_relation").select("id", "entity_start", "entity_end", "created_at"),
        table(spark, folder, "document_node").select("id", "reference", "loaded_at"),
    )


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p6_found(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '', 'g'), '[^a-zA-Z0-9đĐ\-]+', '_', 'g')), '^_+|_+$', '', 'g')"
_FOUND = f"""
WITH doc AS (
  SELECT key, min(created_at) AS since, bool_and(deleted_at IS NOT NULL) AS gone
  FROM (SELECT {_KEY.format("so_hieu")} AS key, created_at, deleted_at FROM document_metadata) WHERE key IS NOT NULL AND key <> '' GROUP BY key
), ends AS (
  SELECT id::VARCHAR AS source_key, field, key, min(created_at) AS t FROM (
    SELECT id, 'entity_start' AS field, {_KEY.format("entity_start")} AS key, created_at FROM document_relation
    UNION ALL SELECT id, 'entity_end', {_KEY.format("entity_end")}, created_at FROM document_relation)
  WHERE key IS NOT NULL AND key <> '' GROUP BY ALL
), own AS (SELECT id, min(loaded_at) AS t FROM document_node WHERE id IS NOT NULL GROUP BY id),
listed AS (
  SELECT DISTINCT id, key FROM (SELECT id, unnest(reference) AS key FROM document_node WHERE id IS NOT NULL)
  WHERE key IS NOT NULL AND trim(key, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''
), judged AS (
  SELECT 'document_relation' AS source_table, e.source_key, e.field, e.key AS target_key, e.t,
    CASE WHEN d.key IS NULL THEN 'missing' WHEN d.gone THEN 'deleted' WHEN d.since > e.t THEN 'late' END AS state
  FROM ends e LEFT JOIN doc d ON d.key = e.key
  UNION ALL
  SELECT 'document_node', l.id, 'reference', l.key, o.t, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.t > o.t THEN 'late' END
  FROM listed l JOIN own o ON o.id = l.id LEFT JOIN own p ON p.id = l.key
), found AS (SELECT source_table, source_key, field, target_key, state, strftime(t, '%Y-%m') AS period FROM judged WHERE state IS NOT NULL)
"""

SQL = {
    "p6_found": _FOUND + "SELECT * FROM found",
    "p6_report": _FOUND + "SELECT source_table, field, period, state, count(*) AS n_references, count(DISTINCT target_key) AS n_targets FROM found GROUP BY ALL",
}
