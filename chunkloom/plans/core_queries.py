"""Registered queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.operators.heavy_keys import heavy_keys, key_profile
from chunkloom.operators.snapshots import snapshot_changes
from chunkloom.runtime import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "file_entries"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "chunks"), share=0.03).select("key_field", "key_value")


def p7_key_profile(spark: SparkSession, folder: str) -> DataFrame:
    return key_profile(table(spark, folder, "chunks"))


_ENTRIES = r"""
WITH clean AS (
  SELECT catalog, snapshot_no, path, arg_max(blob, (loaded_at, blob)) AS blob
  FROM (
    SELECT catalog, snapshot_no, loaded_at, nullif(lower(trim(blob_id)), '') AS blob,
           trim(regexp_replace(regexp_replace('/' || replace(relative_path, '\', '/'), '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/') AS path
    FROM file_entries
  )
  WHERE blob IS NOT NULL AND path <> ''
  GROUP BY ALL
),
snaps AS (
  SELECT *, lead(snapshot_no) OVER (PARTITION BY catalog ORDER BY snapshot_no) AS later
  FROM (SELECT DISTINCT catalog, snapshot_no FROM clean)
),
old AS (SELECT c.catalog, s.later AS snapshot_no, c.path, c.blob FROM clean c JOIN snaps s USING (catalog, snapshot_no) WHERE s.later IS NOT NULL),
new AS (SELECT c.* FROM clean c SEMI JOIN (SELECT catalog, later FROM snaps) s ON c.catalog = s.catalog AND c.snapshot_no = s.later)
SELECT coalesce(o.catalog, n.catalog) AS catalog, coalesce(o.snapshot_no, n.snapshot_no) AS snapshot_no,
       coalesce(o.path, n.path) AS relative_path,
       CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON o.catalog = n.catalog AND o.snapshot_no = n.snapshot_no AND o.path = n.path
WHERE o.blob IS DISTINCT FROM n.blob
"""

_POINTS = r"""
WITH points AS (
  SELECT point_id, arg_max(list_distinct(active_label_ids), len(list_distinct(active_label_ids))) AS labels,
         any_value(package_name) AS package_name, any_value(file_id) AS file_id, any_value(strlen(text)) AS bytes,
         any_value(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END) AS lines
  FROM chunks GROUP BY point_id
),
keyed AS (
  SELECT 'package_name' AS key_field, package_name AS key_value, * FROM points
  UNION ALL SELECT 'file_id', file_id, * FROM points
)
"""

SQL = {
    "p6_found": _ENTRIES,
    "p7_found": _POINTS + "SELECT key_field, key_value FROM keyed WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM points)",
    "p7_key_profile": _POINTS
    + """SELECT key_field, key_value, count(*) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(len(labels)) AS BIGINT) AS label_refs,
         len(list_distinct(flatten(list(labels)))) AS labels FROM keyed GROUP BY key_field, key_value""",
}

QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_key_profile": p7_key_profile}
