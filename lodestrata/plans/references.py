"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from lodestrata.operators import references as R
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()

_FOUND = r"""
WITH refs AS (
  SELECT 'graph_edges' AS ref_table, 'source' AS ref_field, CAST(edge_id AS VARCHAR) AS ref_id, source AS ref_key, source AS lookup, observed_at AS t FROM graph_edges
  UNION ALL
  SELECT 'graph_edges', 'target', CAST(edge_id AS VARCHAR), target, target, observed_at FROM graph_edges
  UNION ALL
  SELECT 'backlog_items', 'linked_code_paths', id, p,
    regexp_replace(regexp_replace(replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '\', '/'), '(#L\d+(-L?\d+)?|:\d+)$', ''), '^(\./|/)+', ''), updated_at
  FROM (SELECT id, updated_at, unnest(linked_code_paths) AS p FROM backlog_items)
), lives AS (
  SELECT 'graph_edges' AS ref_table, id AS k, first_seen_at AS lo, deleted_at AS hi FROM graph_nodes
  UNION ALL
  SELECT 'backlog_items', file_path, scanned_at, deleted_at FROM scanned_files
), missing AS (
  SELECT * FROM refs r WHERE ref_key IS NOT NULL AND regexp_replace(ref_key, '\s+', '', 'g') <> ''
  AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.ref_table = r.ref_table AND l.k = r.lookup AND l.lo <= r.t AND (l.hi IS NULL OR r.t < l.hi))
)
"""


def _orphans(spark, d):
    return R.project_orphans(*(table(spark, d, t) for t in ("graph_nodes", "graph_edges", "scanned_files", "backlog_items")))


@registry.query("p1_found", _FOUND + "SELECT DISTINCT ref_table, ref_field, ref_id, ref_key FROM missing")
def p1_found(spark, d):
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_id", "ref_key").distinct()


@registry.query(
    "p1_by_month",
    _FOUND
    + """SELECT ref_table, ref_field, strftime(date_trunc('month', t), '%Y-%m-%d') AS period, count(*) AS orphans, count(DISTINCT ref_key) AS keys
    FROM (SELECT DISTINCT ref_table, ref_field, ref_id, ref_key, t FROM missing) GROUP BY 1, 2, 3""",
)
def p1_by_month(spark, d):
    return R.count_by_period(_orphans(spark, d))
