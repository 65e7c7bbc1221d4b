"""Queries of the general data operators: drift (p3), snapshots (p4), nesting (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.operators.drift import schema_changes, unified_records, version_steps
from bomloom.operators.shredding import analyse, leaf_values, shred
from bomloom.operators.snapshots import snapshot_changes, with_values
from bomloom.runtime import table

DOC_MARKERS = ("packages", "statements", "spdxVersion", "@context")

#: The columns of the one table with the standard names of their fields (SPDX 2.3 and CycloneDX 1.5) and types.
DRIFT_COLUMNS = {
    "name": (["name"], "string"),
    "version": (["versionInfo", "version"], "string"),
    "licenses": (["licenseDeclared", "licenses.license.id", "licenses.expression"], "array<string>"),
    "license_concluded": (["licenseConcluded"], "string"),
    "purl": (["purl", "externalRefs.referenceLocator"], "string"),
    "supplier": (["supplier", "supplier.name", "publisher"], "string"),
    "originator": (["originator", "author"], "string"),
    "group_name": (["group"], "string"),
    "description": (["description"], "string"),
    "size_bytes": (["packageSize"], "bigint"),
    "weight": (["weight"], "bigint"),
    "files_analyzed": (["filesAnalyzed"], "boolean"),
    "scope": (["scope"], "string"),
    "download_location": (["downloadLocation"], "string"),
    "copyright_text": (["copyrightText", "copyright"], "string"),
}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "drift_records")).select("feed", "file_no", "change_kind", "field_path", "new_path")


#: Every leaf by ``json_tree``; a rename is the pair that is best for both of its paths.
P3_SQL = r"""
WITH docs AS (SELECT rec_no, feed, file_no, body::JSON AS j, coalesce(json_extract_string(body::JSON, '$.SPDXID'), json_extract_string(body::JSON, '$."bom-ref"')) AS ident FROM drift_records WHERE json_valid(body)),
leaves AS (
  SELECT rec_no, feed, file_no, ident, replace(regexp_replace(regexp_replace(t.fullkey, '\[[0-9]+\]', '', 'g'), '^\$\.?', ''), '"', '') AS path,
    CASE WHEN t.type = 'VARCHAR' THEN 1 WHEN t.type = 'BOOLEAN' THEN 4 ELSE 2 END AS bit, regexp_replace(t.atom ->> '$', '^(-?[0-9]+)\.0$', '\1') AS v, t.id AS place
  FROM docs, json_tree(docs.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
files AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS prev FROM (SELECT DISTINCT feed, file_no FROM drift_records)),
schemas AS (SELECT feed, file_no, path, bit_or(bit) AS types FROM leaves GROUP BY ALL),
diff AS (
  SELECT feed, file_no, prev, path, max(old) AS old, max(new) AS new FROM (
    SELECT s.feed, s.file_no, f.prev, path, 0 AS old, types AS new FROM schemas s JOIN files f USING (feed, file_no) WHERE f.prev IS NOT NULL
    UNION ALL SELECT f.feed, f.file_no, f.prev, path, types, 0 FROM schemas s JOIN files f ON f.feed = s.feed AND f.prev = s.file_no)
  GROUP BY ALL HAVING max(old) <> max(new)),
vals AS (SELECT DISTINCT feed, file_no, ident, path, vs FROM (SELECT feed, file_no, rec_no, ident, path, list(v ORDER BY place) AS vs FROM leaves WHERE ident IS NOT NULL GROUP BY ALL)),
per AS (
  SELECT g.feed, g.file_no, g.path AS o, c.path AS n, a.ident, max(CAST(a.vs = b.vs AS INT)) AS same
  FROM diff g JOIN diff c ON g.feed = c.feed AND g.file_no = c.file_no AND g.new = 0 AND c.old = 0
  JOIN vals a ON a.feed = g.feed AND a.file_no = g.prev AND a.path = g.path JOIN vals b ON b.feed = c.feed AND b.file_no = c.file_no AND b.path = c.path AND b.ident = a.ident
  GROUP BY ALL),
scored AS (SELECT feed, file_no, o, n, sum(same) AS s, sum(same) / count(*) AS share FROM per GROUP BY ALL HAVING sum(same) * 2 > count(*)),
renamed AS (
  SELECT feed, file_no, o, n FROM scored
  QUALIFY row_number() OVER (PARTITION BY feed, file_no, o ORDER BY s DESC, share DESC, o, n) = 1 AND row_number() OVER (PARTITION BY feed, file_no, n ORDER BY s DESC, share DESC, o, n) = 1)
SELECT feed, file_no, 'renamed' AS change_kind, o AS field_path, n AS new_path FROM renamed
UNION ALL SELECT d.feed, d.file_no, CASE WHEN new = 0 THEN 'removed' WHEN old = 0 THEN 'added' ELSE 'retyped' END, path, '' FROM diff d
WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = d.feed AND r.file_no = d.file_no AND ((new = 0 AND r.o = d.path) OR (old = 0 AND r.n = d.path)))
"""


def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_steps(table(spark, sf_dir, "drift_records"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = unified_records(table(spark, sf_dir, "drift_records"), DRIFT_COLUMNS, defaults={"scope": "required"})
    return records.withColumn("other", F.to_json("other"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cdx_snapshots")
    changes = snapshot_changes(rows, "bom_serial", "bom_ref", "snap_no", "loaded_at", "row_id", ["name", "version", "purl"])
    found = with_values(changes, rows, "row_id", ["bom_serial", "bom_ref"])
    return found.select("bom_serial", F.col("snap").alias("snap_no"), "bom_ref", F.col("kind").alias("change_kind"))


P4_SQL = """
WITH latest AS (
  SELECT bom_serial, snap_no, bom_ref, name, version, purl FROM cdx_snapshots
  QUALIFY row_number() OVER (PARTITION BY bom_serial, snap_no, bom_ref ORDER BY loaded_at DESC, row_id DESC) = 1),
snaps AS (
  SELECT bom_serial, snap_no, lag(snap_no) OVER w AS prev, lead(snap_no) OVER w AS next
  FROM (SELECT DISTINCT bom_serial, snap_no FROM latest) WINDOW w AS (PARTITION BY bom_serial ORDER BY snap_no)),
rows AS (SELECT l.*, s.prev, s.next FROM latest l JOIN snaps s USING (bom_serial, snap_no))
SELECT n.bom_serial, n.snap_no, n.bom_ref, CASE WHEN o.bom_ref IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM rows n LEFT JOIN latest o ON o.bom_serial = n.bom_serial AND o.bom_ref = n.bom_ref AND o.snap_no = n.prev
WHERE n.prev IS NOT NULL AND (o.bom_ref IS NULL OR o.name IS DISTINCT FROM n.name OR o.version IS DISTINCT FROM n.version OR o.purl IS DISTINCT FROM n.purl)
UNION ALL
SELECT o.bom_serial, o.next, o.bom_ref, 'removed' FROM rows o
WHERE o.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM latest n WHERE n.bom_serial = o.bom_serial AND n.bom_ref = o.bom_ref AND n.snap_no = o.next)
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaf_values(
        table(spark, sf_dir, "nested_docs"),
        "raw_id",
        "body",
        {
            "external_ref": ("packages", "externalRefs", "referenceLocator"),
            "checksum": ("packages", "checksums", "checksumValue"),
            "product": ("statements", "products", "identifiers", "purl"),
        },
        DOC_MARKERS,
    )
    return found.select(F.col("doc_id").alias("raw_id"), F.col("kind").alias("child_kind"), "parent_pos", "child_pos", "leaf_value")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All related tables: their rows with keys, foreign keys and inlined leaves (as JSON)."""
    docs = table(spark, sf_dir, "nested_docs")
    rows = shred(docs, "raw_id", "body", analyse(docs, "body", DOC_MARKERS), DOC_MARKERS)
    return rows.select(F.col("doc_id").alias("raw_id"), "table_name", "node_no", "parent_table", "parent_no", "pos", "path", F.to_json("cols").alias("columns"))


P5_SQL = """
WITH docs AS (
  SELECT raw_id, CASE WHEN json_extract(j, '$.packages') IS NOT NULL OR json_extract(j, '$.statements') IS NOT NULL OR json_extract(j, '$.spdxVersion') IS NOT NULL THEN j
    ELSE coalesce(json_extract(j, '$.document'), json_extract(j, '$.payload'), json_extract(j, '$.sbom'), j) END AS d
  FROM (SELECT raw_id, body::JSON AS j FROM nested_docs WHERE json_valid(body))),
parents AS (
  SELECT raw_id, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) = 'OBJECT' THEN [v] ELSE [] END AS ps
  FROM (SELECT raw_id, 'p' AS k, json_extract(d, '$.packages') AS v FROM docs UNION ALL SELECT raw_id, 's', json_extract(d, '$.statements') FROM docs)),
parent AS (SELECT raw_id, k, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS parent_pos FROM parents),
kids AS (
  SELECT raw_id, kind, parent_pos, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) = 'OBJECT' THEN [v] ELSE [] END AS cs
  FROM (SELECT raw_id, parent_pos, 'external_ref' AS kind, json_extract(p, '$.externalRefs') AS v FROM parent WHERE k = 'p'
        UNION ALL SELECT raw_id, parent_pos, 'checksum', json_extract(p, '$.checksums') FROM parent WHERE k = 'p'
        UNION ALL SELECT raw_id, parent_pos, 'product', json_extract(p, '$.products') FROM parent WHERE k = 's')),
kid AS (SELECT raw_id, kind, parent_pos, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS child_pos FROM kids)
SELECT raw_id, kind AS child_kind, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(child_pos AS INTEGER) AS child_pos, leaf AS leaf_value
FROM (SELECT *, CASE kind WHEN 'external_ref' THEN json_extract_string(c, '$.referenceLocator') WHEN 'checksum' THEN json_extract_string(c, '$.checksumValue')
        ELSE json_extract_string(c, '$.identifiers.purl') END AS leaf FROM kid)
WHERE leaf IS NOT NULL AND leaf <> ''
"""

QUERIES = {"p3_found": p3_found, "p3_steps": p3_steps, "p3_unified": p3_unified, "p4_found": p4_found, "p5_found": p5_found, "p5_tables": p5_tables}
SQL = {"p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
