"""Queries of problem 3 over document_node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.hierarchy import descendant_counts, descendants, hierarchy
from docweave.runtime import table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_node").select("id", "parent_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(_links(spark, folder))


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(_links(spark, folder), with_paths=True)
    return tree.select("id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p3_closure(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(_links(spark, folder))


def p3_descendant_counts(spark: SparkSession, folder: str) -> DataFrame:
    return descendant_counts(_links(spark, folder))


def p3_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Per loop: how many nodes lie on or below it."""
    return hierarchy(_links(spark, folder)).where("depth < 0").groupBy(F.col("root_id").alias("loop_id")).agg(F.count("*").alias("n_nodes"))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_closure": p3_closure, "p3_descendant_counts": p3_descendant_counts, "p3_loops": p3_loops}

_WALK = r"""
WITH RECURSIVE node AS (SELECT id, min(parent_id) AS parent FROM document_node WHERE id IS NOT NULL GROUP BY id),
link AS (SELECT n.id, p.id AS parent FROM node n LEFT JOIN node p ON p.id = n.parent AND trim(n.parent) <> ''),
up(id, cur, way) AS (
  SELECT id, id, [id] FROM node
  UNION ALL
  SELECT u.id, l.parent, list_append(u.way, l.parent) FROM up u JOIN link l ON l.id = u.cur
  WHERE l.parent IS NOT NULL AND NOT list_contains(u.way, l.parent)
),
done AS (SELECT u.id, u.cur, u.way, l.parent AS back FROM up u JOIN link l ON l.id = u.cur WHERE l.parent IS NULL OR list_contains(u.way, l.parent)),
tree AS (
  SELECT id, CASE WHEN back IS NULL THEN cur ELSE list_min(list_slice(way, list_position(way, back), len(way))) END AS root_id,
         CASE WHEN back IS NULL THEN len(way) - 1 ELSE -1 END::INT AS depth, list_reverse(way) AS path
  FROM done
)
"""

SQL = {
    "p3_found": _WALK + "SELECT id, root_id, depth FROM tree",
    "p3_paths": _WALK + "SELECT id, root_id, depth, CASE WHEN depth >= 0 THEN array_to_string(path, ' > ') END AS path FROM tree",
    "p3_closure": _WALK + ", step AS (SELECT id, depth, path, unnest(range(1, depth + 1)) AS k FROM tree WHERE depth > 0) SELECT path[k] AS ancestor_id, id, (depth + 1 - k)::INT AS distance FROM step",
    "p3_descendant_counts": _WALK + ", step AS (SELECT id, depth, path, unnest(range(1, depth + 1)) AS k FROM tree WHERE depth > 0) SELECT path[k] AS ancestor_id, count(*) AS n_descendants, max(depth + 1 - k)::INT AS height FROM step GROUP BY 1",
    "p3_loops": _WALK + "SELECT root_id AS loop_id, count(*) AS n_nodes FROM tree WHERE depth < 0 GROUP BY 1",
}
