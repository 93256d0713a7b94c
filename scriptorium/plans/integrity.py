"""Queries over references between the registry tables (problem 4), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import orphan_report, orphans, source_references
from ..shared import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = source_references(*(table(spark, d, t) for t in ("bundle_registry", "source_allocation", "source_status")))
    parents = table(spark, d, "source_registry").select("source_id", "registered_at", "retired_at")
    found = orphans(refs, parents, key="source_id", at="recorded_at", spread=F.struct("table_name", "record_id"), valid_from="registered_at", valid_to="retired_at")
    return found.withColumn("period", F.date_format("recorded_at", "yyyy-MM"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "period", "record_id", "source_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and cause."""
    return orphan_report(_orphans(spark, d))


_REFS = r"""
refs AS (
  SELECT DISTINCT 'bundle_registry' AS table_name, record_id, recorded_at, lower(trim(x)) AS source_id
  FROM (SELECT record_id, recorded_at, unnest(string_split(primary_sources, '|')) AS x FROM bundle_registry)
  UNION ALL SELECT 'source_allocation', record_id, recorded_at, lower(trim(source_id)) FROM source_allocation
  UNION ALL SELECT 'source_status', record_id, recorded_at, lower(trim(source_id)) FROM source_status
), orphan AS (
  SELECT r.* FROM refs r WHERE r.source_id <> '' AND NOT EXISTS (
    SELECT 1 FROM source_registry p WHERE p.source_id = r.source_id AND p.registered_at <= r.recorded_at
      AND (p.retired_at IS NULL OR r.recorded_at < p.retired_at))
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_report": p4_report}
SQL: dict[str, str] = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT table_name, strftime(recorded_at, '%Y-%m') AS period, record_id, source_id FROM orphan",
    "p4_report": f"""WITH {_REFS}
SELECT table_name, strftime(recorded_at, '%Y-%m') AS period, orphan_cause, count(*) AS orphans, count(DISTINCT source_id) AS keys FROM (
  SELECT o.*, CASE
    WHEN NOT EXISTS (SELECT 1 FROM source_registry p WHERE p.source_id = o.source_id AND p.registered_at IS NOT NULL AND (p.retired_at IS NULL OR p.retired_at > p.registered_at)) THEN 'missing'
    WHEN o.recorded_at IS NULL THEN 'undated'
    WHEN EXISTS (SELECT 1 FROM source_registry p WHERE p.source_id = o.source_id AND p.registered_at <= o.recorded_at AND (p.retired_at IS NULL OR p.retired_at > p.registered_at)) THEN 'deleted'
    ELSE 'late' END AS orphan_cause
  FROM orphan o) GROUP BY 1, 2, 3""",
}
