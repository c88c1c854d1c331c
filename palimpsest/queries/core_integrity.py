"""Queries on references to records that do not exist: all of them come from the orphan cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import integrity
from palimpsest.tables import load

TABLES = ["entity", "observation", "relationship"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of a current record to an entity: the direct round of the cascade over entities."""
    found = integrity.memory_orphans(*(load(spark, sf_dir, t) for t in TABLES))
    return found.filter("how = 'direct'").select("src_table", "src_key", "ref_field", "ref_id", "ref_month", "kind")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, kind and month."""
    return p2_found(spark, sf_dir).groupBy("src_table", "ref_field", "kind", "ref_month").agg(F.count("*").alias("n_refs"))


def p2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every direct and inherited orphan along observation, relationship -> entity; observation -> task, session; task -> session."""
    found = integrity.memory_orphans(*(load(spark, sf_dir, t) for t in [*TABLES, "session_state", "task_state"]))
    return found.select("src_table", "src_key", "ref_field", "ref_id", "ref_month", "kind", "depth", "how")


def p2_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphan references per table, field, kind, depth and month."""
    found = p2_orphans(spark, sf_dir)
    return found.groupBy("src_table", "ref_field", "how", "kind", "depth", "ref_month").agg(F.count("*").alias("n_refs"))


_KEY = "coalesce(from_id, '') || '|' || coalesce(to_id, '') || '|' || coalesce(relation_type, '')"
_REFS = f"""
WITH RECURSIVE e AS (SELECT lower(trim(id)) AS ref_id, valid_from, asserted FROM entity),
latest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY valid_from DESC, asserted) = 1),
firsts AS (SELECT ref_id, min(valid_from) FILTER (WHERE asserted) AS first_at FROM e GROUP BY ref_id),
o AS (SELECT * FROM observation QUALIFY row_number() OVER (PARTITION BY id ORDER BY valid_from DESC, asserted) = 1),
r AS (SELECT * FROM relationship QUALIFY row_number() OVER (PARTITION BY from_id, to_id, relation_type ORDER BY valid_from DESC, asserted) = 1),
states AS (
  SELECT 'entity' AS parent, ref_id, asserted AS alive, first_at FROM latest JOIN firsts USING (ref_id)
  UNION ALL SELECT DISTINCT 'session', lower(trim(session_id)), true, NULL FROM session_state WHERE session_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'task', lower(trim(task_id)), true, NULL FROM task_state WHERE task_id IS NOT NULL),
refs AS (
  SELECT * FROM (
  SELECT 'observation' AS src_table, id AS src_key, 'entity_id' AS ref_field, lower(trim(entity_id)) AS ref_id, valid_from, 'entity' AS parent FROM o WHERE asserted
  UNION ALL SELECT 'relationship', {_KEY}, 'from_id', lower(trim(from_id)), valid_from, 'entity' FROM r WHERE asserted
  UNION ALL SELECT 'relationship', {_KEY}, 'to_id', lower(trim(to_id)), valid_from, 'entity' FROM r WHERE asserted
  UNION ALL SELECT 'observation', id, 'session_id', lower(trim(session_id)), valid_from, 'session' FROM o WHERE asserted
  UNION ALL SELECT 'observation', id, 'task_id', lower(trim(task_id)), valid_from, 'task' FROM o WHERE asserted
  UNION ALL SELECT 'task', lower(trim(task_id)), 'session_id', lower(trim(session_id)), NULL, 'session' FROM task_state WHERE task_id IS NOT NULL)
  WHERE ref_id <> ''),
direct AS (
  SELECT DISTINCT src_table, src_key, ref_field, refs.ref_id, strftime(refs.valid_from, '%Y-%m') AS ref_month, refs.parent,
    CASE WHEN s.ref_id IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' WHEN first_at > refs.valid_from THEN 'late' END AS kind
  FROM refs LEFT JOIN states s ON s.parent = refs.parent AND s.ref_id = refs.ref_id),
"""
_FOUND = _REFS + "found AS (SELECT src_table, src_key, ref_field, ref_id, ref_month, kind FROM direct WHERE kind IS NOT NULL AND parent = 'entity')\n"
_ORPHANS = (
    _REFS
    + """
orphan(src_table, src_key, depth) AS (
  SELECT DISTINCT src_table, src_key, 0 FROM direct WHERE kind IS NOT NULL
  UNION SELECT refs.src_table, refs.src_key, depth + 1 FROM orphan JOIN refs ON refs.parent = orphan.src_table AND refs.ref_id = lower(trim(orphan.src_key))
  WHERE depth < 1000),
first AS (SELECT src_table, src_key, min(depth) AS depth FROM orphan GROUP BY ALL),
orphans AS (
  SELECT src_table, src_key, ref_field, ref_id, ref_month, kind, 0 AS depth, 'direct' AS how FROM direct WHERE kind IS NOT NULL
  UNION ALL SELECT DISTINCT refs.src_table, refs.src_key, ref_field, ref_id, strftime(valid_from, '%Y-%m'), 'inherited', f.depth, 'inherited'
  FROM refs JOIN first f ON f.src_table = refs.src_table AND f.src_key = refs.src_key
  JOIN first p ON p.src_table = refs.parent AND lower(trim(p.src_key)) = refs.ref_id AND p.depth = f.depth - 1
  WHERE f.depth > 0)
"""
)

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_cascade": p2_cascade, "p2_orphans": p2_orphans}
SQL = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_counts": _FOUND + "SELECT src_table, ref_field, kind, ref_month, count(*) AS n_refs FROM found GROUP BY ALL",
    "p2_orphans": _ORPHANS + "SELECT * FROM orphans",
    "p2_cascade": _ORPHANS + "SELECT src_table, ref_field, how, kind, depth, ref_month, count(*) AS n_refs FROM orphans GROUP BY ALL",
}
