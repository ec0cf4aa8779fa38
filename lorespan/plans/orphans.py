"""Queries on references to pages that don't exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespan.operators.orphans import orphan_references, orphan_report, page_sources
from lorespan.session import table


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    nodes, lint, drift = (table(spark, folder, name) for name in ("retrieval_nodes", "lint_results", "schema_drift_findings"))
    return orphan_references(page_sources(nodes, lint, drift), nodes)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(spark, folder).where("kind = 'direct'").select("ref_table", "ref_id", "target_key").distinct()


QUERIES = {
    "p3_found": p3_found,
    "p3_cascade": lambda spark, folder: orphans(spark, folder).select("ref_table", "ref_id", "target_key", "kind").distinct(),
    "p3_report": lambda spark, folder: orphan_report(orphans(spark, folder)),
}

_KEY = r"""CASE WHEN {0} NOT LIKE '%://%' THEN nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(
  regexp_replace(trim({0}, ' '), '^\[\[(.*)\]\]$', '\1', 's'), '[|#].*', '', 's'), ' '), '^.*/', '', 's')), '\.md$', ''), '[ _-]+', '-', 'g'), '-'), '') END"""

_DIRECT = f"""
links AS (
  SELECT 'retrieval_nodes' AS ref_table, row_id AS ref_id, project_id, indexed_at AS t, unnest(out_links) AS link FROM retrieval_nodes
  UNION ALL SELECT 'lint_results', lint_id, project_id, run_at, unnest(affected_pages) FROM lint_results
  UNION ALL SELECT 'schema_drift_findings', finding_id, project_id, detected_at, relation_target FROM schema_drift_findings),
refs AS (SELECT DISTINCT * FROM (SELECT ref_table, ref_id, project_id, t, {_KEY.format('link')} AS target_key FROM links) WHERE target_key IS NOT NULL),
names AS (SELECT project_id, node_id AS k, row_id, created_at, deleted_at FROM retrieval_nodes
  UNION SELECT project_id, {_KEY.format('al')}, row_id, created_at, deleted_at FROM (SELECT *, unnest(aliases) AS al FROM retrieval_nodes)),
edges AS (SELECT DISTINCT r.*, n.row_id FROM refs r LEFT JOIN names n ON n.project_id = r.project_id AND n.k = r.target_key
  AND n.created_at <= r.t AND (n.deleted_at IS NULL OR r.t < n.deleted_at))"""

_ALL = f"""WITH RECURSIVE {_DIRECT},
orphaned(row_id) AS (
  SELECT DISTINCT ref_id FROM edges WHERE row_id IS NULL AND ref_table = 'retrieval_nodes'
  UNION SELECT e.ref_id FROM orphaned o JOIN edges e ON e.row_id = o.row_id AND e.ref_table = 'retrieval_nodes'),
hanging AS (SELECT DISTINCT ref_table, ref_id, target_key, t, 'direct' AS kind FROM edges WHERE row_id IS NULL
  UNION ALL SELECT DISTINCT e.ref_table, e.ref_id, e.target_key, e.t, 'inherited' FROM edges e JOIN orphaned o ON e.row_id = o.row_id)"""

SQL = {
    "p3_found": f"WITH {_DIRECT} SELECT DISTINCT ref_table, ref_id, target_key FROM edges WHERE row_id IS NULL",
    "p3_cascade": f"{_ALL} SELECT DISTINCT ref_table, ref_id, target_key, kind FROM hanging",
    "p3_report": f"""{_ALL}, each AS (SELECT ref_table, ref_id, strftime(t, '%Y-%m') AS month, count_if(kind = 'direct') AS direct, count_if(kind = 'inherited') AS inherited FROM hanging GROUP BY ALL)
SELECT ref_table, month, sum(direct)::BIGINT AS direct, sum(inherited)::BIGINT AS inherited, count(*) AS records, count_if(direct > 0)::BIGINT AS direct_records FROM each GROUP BY ALL""",
}
