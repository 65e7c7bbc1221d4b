"""Queries of search, diff and fleet operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom import testdata
from bomloom.model import Tables
from bomloom.operators import differ, fleet, search
from bomloom.operators.set_join import similar_sets
from bomloom.runtime import materialize, table

M = f"WITH RECURSIVE {testdata.MODEL_SQL}"
PAIRS = """,
ids AS (SELECT DISTINCT sbom_id FROM components),
pairs AS (SELECT old_sbom, new_sbom FROM (SELECT sbom_id AS old_sbom, lead(sbom_id) OVER (ORDER BY sbom_id) AS new_sbom FROM ids) WHERE new_sbom IS NOT NULL)"""
RANK = "CASE severity WHEN 'critical' THEN 6 WHEN 'high' THEN 5 WHEN 'medium' THEN 4 WHEN 'low' THEN 3 WHEN 'info' THEN 2 WHEN 'none' THEN 1 ELSE 0 END"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- search -----------------------------------------------------------------
_MERGED = """
  SELECT lower(name) AS name_key, coalesce(version, '') AS version, arg_min(name, (sbom_id, id)) AS name, arg_min_null(ecosystem, (sbom_id, id)) AS ecosystem, arg_min_null(licence, (sbom_id, id)) AS licence,
    array_to_string(list_sort(list_distinct(list(sbom_id))), ',') AS found_in, count(*) AS hits FROM found GROUP BY 1, 2"""
_MERGED_IDS = """
  SELECT lower(name) AS name_key, coalesce(version, '') AS version, array_to_string(list_sort(list_distinct(list(vuln_id))), ',') AS vuln_ids
  FROM found JOIN vulns v ON v.sbom_id = found.sbom_id AND v.component_id = found.id GROUP BY 1, 2"""


@query(f"{M}, found AS (SELECT * FROM components WHERE contains(lower(name), 'ring') AND lower(ecosystem) = 'npm'), m AS ({_MERGED}), v AS ({_MERGED_IDS}) SELECT m.* EXCLUDE (licence), coalesce(m.licence, '') AS licence, coalesce(v.vuln_ids, '') AS vuln_ids FROM m LEFT JOIN v USING (name_key, version)")
def fleet_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merged_hits(testdata.tables(spark, sf_dir), search.Query(name="ring", ecosystem="npm")).fillna("", ["licence"])


@query(f"{M}, found AS (SELECT * FROM components WHERE contains(lower(name), 'gear') OR contains(lower(coalesce(version, '')), 'gear') OR contains(lower(coalesce(purl, '')), 'gear') OR contains(id, 'gear')), n AS (SELECT sbom_id, count(*) AS n_hits FROM found GROUP BY 1) SELECT sbom_id, count(*) AS n_components, any_value(coalesce(n_hits, 0)) AS n_hits FROM components LEFT JOIN n USING (sbom_id) GROUP BY sbom_id")
def fleet_query_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_summary(testdata.tables(spark, sf_dir), search.Query(pattern="GEAR"))


@query(f"{M} SELECT sbom_id, id, version FROM components WHERE CAST(split_part(version, '.', 1) AS INT) >= 2 AND (CAST(split_part(version, '.', 1) AS INT) < 5 OR (CAST(split_part(version, '.', 1) AS INT) = 5 AND CAST(split_part(version, '.', 2) AS INT) < 1))")
def fleet_query_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(testdata.tables(spark, sf_dir), search.Query(version=">=2, <5.1")).select("sbom_id", "id", "version")


@query(f"{M} SELECT c.sbom_id, c.id FROM components c WHERE contains(lower(licence), 'gpl') AND contains(lower(supplier), 'brand#1') AND EXISTS (SELECT 1 FROM vulns v WHERE v.sbom_id = c.sbom_id AND v.component_id = c.id AND v.vuln_id = 'CVE-2024-0042')")
def fleet_query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(testdata.tables(spark, sf_dir), search.Query(licence="gpl", supplier="brand#1", affected_by="cve-2024-0042")).select("sbom_id", "id")


@query(f"{M}, w AS (SELECT sbom_id, component_id AS id, max({RANK}) AS worst FROM vulns GROUP BY 1, 2) SELECT sbom_id, id, coalesce(worst, -1) AS worst FROM components LEFT JOIN w USING (sbom_id, id) WHERE (worst IS NULL OR worst >= 5) AND ecosystem = 'cargo'")
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.view(testdata.tables(spark, sf_dir), min_severity="high", ecosystem="cargo").select("sbom_id", "id", F.coalesce("worst", F.lit(-1)).alias("worst"))


@query(f"""{M}, f AS (SELECT CASE WHEN contains(lower(name), 'bolt') THEN 0 WHEN contains(lower(purl), 'bolt') THEN 1 END AS rank, CASE WHEN contains(lower(name), 'bolt') THEN 'name' ELSE 'purl' END AS match_field, sbom_id, id, name AS label FROM components
  UNION ALL SELECT 2, 'vulnerability', sbom_id, component_id, vuln_id FROM vulns WHERE contains(lower(vuln_id), 'bolt')) SELECT * FROM f WHERE rank IS NOT NULL ORDER BY rank, label, sbom_id, id LIMIT 50""")
def ui_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_everything(testdata.tables(spark, sf_dir), "bolt")


@query(f"{M} SELECT v.sbom_id, vuln_id, count(*) AS affected, max(cvss) AS max_cvss, arg_min(severity, component_id) AS severity, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM vulns v JOIN components c ON c.sbom_id = v.sbom_id AND c.id = v.component_id WHERE {RANK} >= 4 GROUP BY 1, 2")
def ui_vulnerability_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vulnerability_list(testdata.tables(spark, sf_dir), "medium")


def _tree_sql(by: str) -> str:
    return f"{M}, n AS (SELECT sbom_id, component_id AS id, count(*) AS v FROM vulns GROUP BY 1, 2) SELECT sbom_id, coalesce({by}, 'Unknown') AS label, count(*) AS items, CAST(coalesce(sum(v), 0) AS BIGINT) AS vulns FROM components LEFT JOIN n USING (sbom_id, id) GROUP BY 1, 2"


@query(_tree_sql("ecosystem"))
def ui_tree_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grouped_tree(testdata.tables(spark, sf_dir), "ecosystem")


@query(_tree_sql("licence"))
def ui_tree_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grouped_tree(testdata.tables(spark, sf_dir), "licence")


@query(f"{M}, w AS (SELECT sbom_id, component_id AS id, arg_max(severity, {RANK}) AS bucket FROM vulns GROUP BY 1, 2) SELECT sbom_id, coalesce(bucket, 'clean') AS bucket, count(*) AS items FROM components LEFT JOIN w USING (sbom_id, id) GROUP BY 1, 2")
def ui_tree_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.severity_tree(testdata.tables(spark, sf_dir))


# --- diff -------------------------------------------------------------------
def _diff(spark: SparkSession, sf_dir: str, cut: bool = False):
    t = testdata.tables(spark, sf_dir, cut)
    pairs = differ.consecutive_pairs(t)
    return t, pairs, differ.identity_matches(t, pairs)


CHANGES = """,
o AS (SELECT p.old_sbom, p.new_sbom, c.* FROM pairs p JOIN components c ON c.sbom_id = p.old_sbom),
n AS (SELECT p.old_sbom, p.new_sbom, c.* FROM pairs p JOIN components c ON c.sbom_id = p.new_sbom),
both_sides AS (SELECT n.old_sbom, n.new_sbom, n.id, n.name, o.version IS DISTINCT FROM n.version AS v, o.licence IS DISTINCT FROM n.licence AS l, o.supplier IS DISTINCT FROM n.supplier AS s,
  o.version IS NOT DISTINCT FROM n.version AND coalesce(o.hash <> n.hash, false) AS h,
  CASE WHEN o.version IS NULL AND n.version IS NULL THEN 0 WHEN o.version IS NULL OR n.version IS NULL THEN 4 WHEN split_part(o.version, '.', 1) <> split_part(n.version, '.', 1) THEN 7
    WHEN split_part(o.version, '.', 2) <> split_part(n.version, '.', 2) THEN 4 WHEN split_part(o.version, '.', 3) <> split_part(n.version, '.', 3) THEN 2 ELSE 0 END AS step
  FROM n JOIN o ON o.old_sbom = n.old_sbom AND o.new_sbom = n.new_sbom AND o.id = n.id),
changes AS (
  SELECT old_sbom, new_sbom, 'removed' AS kind, id, name, '' AS fields, 10 AS cost FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.old_sbom = o.old_sbom AND n.new_sbom = o.new_sbom AND n.id = o.id)
  UNION ALL SELECT old_sbom, new_sbom, 'added', id, name, '', 10 FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.old_sbom = n.old_sbom AND o.new_sbom = n.new_sbom AND o.id = n.id)
  UNION ALL SELECT old_sbom, new_sbom, 'modified', id, name, concat_ws(',', CASE WHEN v THEN 'version' END, CASE WHEN l THEN 'licences' END, CASE WHEN s THEN 'supplier' END, CASE WHEN h THEN 'hashes' END),
    CASE WHEN v THEN step ELSE 0 END + CASE WHEN l THEN 6 ELSE 0 END + CASE WHEN s THEN 4 ELSE 0 END + CASE WHEN h THEN 8 ELSE 0 END FROM both_sides WHERE v OR l OR s OR h)"""
EDGE_CHANGES = """,
oe AS (SELECT p.old_sbom, p.new_sbom, e.from_id, e.to_id, e.relationship, e.scope FROM pairs p JOIN edges e ON e.sbom_id = p.old_sbom),
ne AS (SELECT p.old_sbom, p.new_sbom, e.from_id, e.to_id, e.relationship, e.scope FROM pairs p JOIN edges e ON e.sbom_id = p.new_sbom),
edge_changes AS (SELECT *, 'added' AS kind FROM (SELECT * FROM ne EXCEPT ALL SELECT * FROM oe) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM oe EXCEPT ALL SELECT * FROM ne))"""
VULN_CHANGES = """,
ov AS (SELECT DISTINCT p.old_sbom, p.new_sbom, v.vuln_id, v.component_id, v.severity FROM pairs p JOIN vulns v ON v.sbom_id = p.old_sbom),
nv AS (SELECT DISTINCT p.old_sbom, p.new_sbom, v.vuln_id, v.component_id, v.severity FROM pairs p JOIN vulns v ON v.sbom_id = p.new_sbom),
vuln_changes AS (SELECT nv.*, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.old_sbom = nv.old_sbom AND ov.new_sbom = nv.new_sbom AND ov.vuln_id = nv.vuln_id) THEN 'persistent' ELSE 'introduced' END AS kind FROM nv
  UNION ALL SELECT ov.*, 'resolved' FROM ov WHERE NOT EXISTS (SELECT 1 FROM nv WHERE nv.old_sbom = ov.old_sbom AND nv.new_sbom = ov.new_sbom AND nv.vuln_id = ov.vuln_id))"""


@query(f"{M}{PAIRS}{CHANGES} SELECT old_sbom, new_sbom, kind, id, name, fields, CAST(cost AS INTEGER) AS cost FROM changes")
def diff_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differ.component_changes(*_diff(spark, sf_dir))


@query(f"{M}{PAIRS}{EDGE_CHANGES} SELECT * FROM edge_changes")
def diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differ.edge_changes(*_diff(spark, sf_dir))


@query(f"{M}{PAIRS}, per AS (SELECT sbom_id, licence || '/' || name || '/' || supplier AS licence, count(*) AS n_components FROM components WHERE licence IS NOT NULL AND supplier IS NOT NULL GROUP BY 1, 2), o AS (SELECT p.*, licence, n_components FROM pairs p JOIN per ON sbom_id = old_sbom), n AS (SELECT p.*, licence, n_components FROM pairs p JOIN per ON sbom_id = new_sbom) SELECT *, 'new' AS kind FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.old_sbom = n.old_sbom AND o.licence = n.licence) UNION ALL SELECT *, 'removed' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.old_sbom = o.old_sbom AND o.licence = n.licence)")
def diff_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, _ = _diff(spark, sf_dir)
    fine = t.components.withColumn("licence", F.concat("licence", F.lit("/"), "name", F.lit("/"), "supplier"))  # three licences alone never change
    return differ.licence_changes(Tables(fine, t.edges, t.vulns), pairs)


@query(f"{M}{PAIRS}{VULN_CHANGES} SELECT * FROM vuln_changes")
def diff_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, _ = _diff(spark, sf_dir)
    return differ.vulnerability_changes(t, pairs)


_SUMMARY = f"""{CHANGES}{EDGE_CHANGES}{VULN_CHANGES},
c AS (SELECT old_sbom, new_sbom, count(*) FILTER (kind = 'added') AS components_added, count(*) FILTER (kind = 'removed') AS components_removed, count(*) FILTER (kind = 'modified') AS components_modified, sum(cost) AS component_cost FROM changes GROUP BY 1, 2),
e AS (SELECT old_sbom, new_sbom, count(*) FILTER (kind = 'added') AS edges_added, count(*) FILTER (kind = 'removed') AS edges_removed FROM edge_changes GROUP BY 1, 2),
v AS (SELECT old_sbom, new_sbom, count(*) FILTER (kind = 'introduced') AS vulns_introduced, count(*) FILTER (kind = 'resolved') AS vulns_resolved, count(*) FILTER (kind = 'persistent') AS vulns_persistent FROM vuln_changes GROUP BY 1, 2)
SELECT * EXCLUDE (component_cost), components_added + components_removed + components_modified + edges_added + edges_removed AS total_changes,
  CAST(component_cost + 5 * edges_added + 5 * edges_removed + 15 * vulns_introduced - 3 * vulns_resolved AS DOUBLE) AS score
FROM pairs JOIN c USING (old_sbom, new_sbom) JOIN e USING (old_sbom, new_sbom) JOIN v USING (old_sbom, new_sbom)"""
_BASELINE = ", ids AS (SELECT DISTINCT sbom_id FROM components), pairs AS (SELECT 1996 AS old_sbom, sbom_id AS new_sbom FROM ids WHERE sbom_id <> 1996)"
_CUMULATIVE = ", ids AS (SELECT DISTINCT sbom_id FROM components), pairs AS (SELECT (SELECT min(sbom_id) FROM ids) AS old_sbom, sbom_id AS new_sbom FROM ids WHERE sbom_id > (SELECT min(sbom_id) FROM ids))"


def _summary(t: Tables, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    return differ.summary(differ.component_changes(t, pairs, matches), differ.edge_changes(t, pairs, matches), differ.vulnerability_changes(t, pairs), pairs)


@query(f"{M}{PAIRS}{_SUMMARY}")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(*_diff(spark, sf_dir, cut=True))


@query(f"{M}{_BASELINE}{_SUMMARY}")
def multi_baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir, cut=True)
    pairs = differ.baseline_pairs(t, 1996)
    return _summary(t, pairs, differ.identity_matches(t, pairs))


@query(f"{M}{_CUMULATIVE}{_SUMMARY}")
def timeline_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir, cut=True)
    pairs = differ.cumulative_pairs(t)
    return _summary(t, pairs, differ.identity_matches(t, pairs))


_SCORES = _SUMMARY.replace("GROUP BY 1, 2)\nSELECT * EXCLUDE", "GROUP BY 1, 2),\nscores AS (SELECT * EXCLUDE") + ")"


@query(f"{M}{_BASELINE}{_SCORES} SELECT old_sbom, new_sbom, 100 - score AS deviation, greatest(max(100 - score) OVER (PARTITION BY old_sbom), 0) AS max_deviation FROM scores")
def multi_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differ.deviations(multi_baseline_summary(spark, sf_dir))


@query(f"{M}{PAIRS}{VULN_CHANGES} SELECT old_sbom, new_sbom, severity, count(*) AS n FROM vuln_changes WHERE kind = 'introduced' GROUP BY 1, 2, 3")
def diff_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, _ = _diff(spark, sf_dir)
    return differ.introduced_severities(differ.vulnerability_changes(t, pairs))


@query()
def diff_matched_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff on identity matches and the assignment of what they leave."""
    t = testdata.tables(spark, sf_dir, cut=True)
    pairs = differ.consecutive_pairs(t)
    return differ.component_changes(t, pairs, differ.full_matches(t, pairs))


@query()
def diff_matched_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir, cut=True)
    pairs = differ.consecutive_pairs(t)
    return _summary(t, pairs, materialize(differ.full_matches(t, pairs), "matches"))


@query(f"{M} SELECT sbom_id, component_id, count(*) AS n_vulns, arg_max(severity, {RANK}) AS worst, max(cvss) AS max_cvss, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high FROM vulns GROUP BY 1, 2")
def vulnerability_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differ.vulnerability_groups(testdata.tables(spark, sf_dir).vulns)


@query(f"{M} SELECT sbom_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity NOT IN ('critical', 'high', 'medium', 'low')) AS unknown FROM vulns GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differ.severity_counts(testdata.tables(spark, sf_dir))


@query(f"""{M}{PAIRS}{CHANGES}{EDGE_CHANGES}{VULN_CHANGES} SELECT p.old_sbom, p.new_sbom, EXISTS (SELECT 1 FROM changes c WHERE c.old_sbom = p.old_sbom) AS components_changed, EXISTS (SELECT 1 FROM edge_changes c WHERE c.old_sbom = p.old_sbom) AS edges_changed,
  EXISTS (SELECT 1 FROM both_sides c WHERE c.old_sbom = p.old_sbom AND l) OR EXISTS (SELECT 1 FROM changes c WHERE c.old_sbom = p.old_sbom AND kind <> 'modified') AS licences_changed, (SELECT list(component_id || vuln_id ORDER BY component_id, vuln_id) FROM ov WHERE ov.old_sbom = p.old_sbom) <> (SELECT list(component_id || vuln_id ORDER BY component_id, vuln_id) FROM nv WHERE nv.old_sbom = p.old_sbom) AS vulns_changed FROM pairs p""")
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, _ = _diff(spark, sf_dir)
    return differ.section_flags(t, pairs)


# --- fleet ------------------------------------------------------------------
@query(f"{M} SELECT id, count(DISTINCT sbom_id) AS present FROM components GROUP BY 1 HAVING count(DISTINCT sbom_id) = (SELECT count(DISTINCT sbom_id) FROM components)")
def multi_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.universal(testdata.tables(spark, sf_dir))


@query(f"{M} SELECT id, count(DISTINCT coalesce(version, '')) AS n_versions, min(coalesce(version, '')) AS min_version, max(coalesce(version, '')) AS max_version, CAST(coalesce(max(CAST(split_part(version, '.', 1) AS BIGINT)) - min(CAST(split_part(version, '.', 1) AS BIGINT)), 0) AS BIGINT) AS major_spread, min(name) AS name FROM components GROUP BY 1 HAVING count(DISTINCT coalesce(version, '')) > 1")
def multi_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.variable(testdata.tables(spark, sf_dir))


@query(f"{M}, n AS (SELECT count(DISTINCT sbom_id) AS n FROM components) SELECT id, count(DISTINCT sbom_id) AS present_in, any_value(n) - count(DISTINCT sbom_id) AS missing_from FROM components, n GROUP BY id HAVING count(DISTINCT sbom_id) < any_value(n)")
def multi_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.inconsistent(testdata.tables(spark, sf_dir))


@query(f"""{M}, b AS (SELECT id, version AS baseline_version FROM components WHERE sbom_id = 1996), o AS (SELECT sbom_id, id, coalesce(version, '') AS target_version FROM components WHERE sbom_id <> 1996)
SELECT o.sbom_id, o.id, CASE WHEN baseline_version IS NULL THEN 'added' ELSE 'version_mismatch' END AS kind, baseline_version, target_version FROM o LEFT JOIN b USING (id) WHERE baseline_version IS NULL OR baseline_version <> target_version
UNION ALL SELECT d.sbom_id, b.id, 'removed', baseline_version, '' FROM b, (SELECT DISTINCT sbom_id FROM o) d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.sbom_id = d.sbom_id AND o.id = b.id)""")
def multi_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.divergent(testdata.tables(spark, sf_dir), 1996)


@query(f"{M}, n AS (SELECT count(DISTINCT sbom_id) AS n FROM components), p AS (SELECT vuln_id, count(DISTINCT sbom_id) AS documents, min(sbom_id) AS first_in FROM vulns GROUP BY 1) SELECT vuln_id, documents, CASE WHEN documents = n THEN 'common' WHEN documents = 1 THEN 'unique' ELSE 'shared' END AS scope, CASE WHEN documents = 1 THEN first_in END AS only_in FROM p, n")
def vuln_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.vulnerability_matrix(testdata.tables(spark, sf_dir))


_HISTORY = """,
docs AS (SELECT sbom_id, row_number() OVER (ORDER BY sbom_id) AS snapshot FROM (SELECT DISTINCT sbom_id FROM components)),
grid AS (SELECT d.sbom_id, d.snapshot, i.id, CASE WHEN c.id IS NOT NULL THEN coalesce(c.version, '') END AS v FROM (SELECT DISTINCT id FROM components) i CROSS JOIN docs d LEFT JOIN components c ON c.sbom_id = d.sbom_id AND c.id = i.id),
marked AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, lag(v) OVER (PARTITION BY id ORDER BY snapshot) IS NOT NULL AS was_here FROM grid),
nums AS (SELECT *, CASE WHEN v <> '' THEN [CAST(x AS INT) FOR x IN string_split(v, '.')] END AS c, CASE WHEN previous <> '' THEN [CAST(x AS INT) FOR x IN string_split(previous, '.')] END AS p FROM marked),
history AS (SELECT sbom_id, id, v AS version, CASE WHEN v IS NULL AND previous IS NULL THEN 'absent' WHEN v IS NULL AND was_here THEN 'removed' WHEN v IS NULL THEN 'absent' WHEN previous IS NULL THEN 'initial' WHEN v = previous THEN 'unchanged'
  WHEN c IS NULL OR p IS NULL THEN CASE WHEN v > previous THEN 'patch_upgrade' ELSE 'downgrade' END WHEN c <= p THEN 'downgrade' WHEN c[1] > p[1] THEN 'major_upgrade' WHEN c[2] > p[2] THEN 'minor_upgrade' ELSE 'patch_upgrade' END AS change FROM nums)"""


@query(f"{M}{_HISTORY} SELECT * FROM history WHERE change <> 'absent'")
def timeline_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.history(testdata.tables(spark, sf_dir))


@query(f"{M}{_HISTORY}, l AS (SELECT max(sbom_id) AS newest, min(sbom_id) AS oldest FROM components), s AS (SELECT id, min(sbom_id) AS first_seen, max(sbom_id) AS last_seen FROM components GROUP BY 1), c AS (SELECT id, count(*) FILTER (change LIKE '%upgrade' OR change = 'downgrade') AS version_changes FROM history GROUP BY 1) SELECT id, first_seen, last_seen, last_seen = newest AS still_present, first_seen > oldest AS was_added, version_changes FROM s JOIN c USING (id), l")
def timeline_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.evolution(testdata.tables(spark, sf_dir))


@query(f"{M}, n AS (SELECT sbom_id, count(*) AS components FROM components GROUP BY 1), e AS (SELECT sbom_id, count(*) AS edges FROM edges GROUP BY 1), d AS (SELECT sbom_id, count(*) AS direct_edges FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.sbom_id = e.sbom_id AND f.to_id = e.from_id) GROUP BY 1), v AS (SELECT sbom_id, count(*) AS vulns, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM vulns GROUP BY 1) SELECT * FROM n JOIN e USING (sbom_id) JOIN d USING (sbom_id) JOIN v USING (sbom_id)")
def timeline_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.trends(testdata.tables(spark, sf_dir))


_MATRIX = ", s AS (SELECT sbom_id, count(DISTINCT id) AS n FROM components GROUP BY 1), h AS (SELECT a.sbom_id AS a, b.sbom_id AS b, count(*) AS shared FROM components a JOIN components b ON a.id = b.id AND a.sbom_id < b.sbom_id GROUP BY 1, 2)"


@query(f"{M}{_MATRIX} SELECT x.sbom_id AS a, y.sbom_id AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 9) AS jaccard FROM s x JOIN s y ON x.sbom_id < y.sbom_id LEFT JOIN h ON h.a = x.sbom_id AND h.b = y.sbom_id")
def matrix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.similarity_matrix(testdata.tables(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


@query()
def matrix_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir)
    return fleet.leader_clusters(t.components.select("sbom_id"), fleet.similar_documents(t, 0.9))


@query(f"{M}{_MATRIX} SELECT a, b, shared, round(shared / (x.n + y.n - shared), 9) AS jaccard FROM h JOIN s x ON x.sbom_id = a JOIN s y ON y.sbom_id = b WHERE shared / (x.n + y.n - shared) >= 0.9")
def matrix_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.similar_documents(testdata.tables(spark, sf_dir), 0.9).withColumn("jaccard", F.round("jaccard", 9))


_BOMS = "boms AS (SELECT DISTINCT snap_no || '/' || bom_serial AS doc, bom_ref AS id FROM cdx_snapshots)"


@query(f"WITH {_BOMS}, s AS (SELECT doc, count(*) AS n FROM boms GROUP BY 1), h AS (SELECT a.doc AS a, b.doc AS b, count(*) AS shared FROM boms a JOIN boms b ON a.id = b.id AND a.doc < b.doc GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 9) AS jaccard FROM h JOIN s x ON x.doc = a JOIN s y ON y.doc = b WHERE shared / (x.n + y.n - shared) >= 0.8")
def matrix_similar_boms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of every bom as a document."""
    rows = table(spark, sf_dir, "cdx_snapshots").select(F.concat_ws("/", F.col("snap_no").cast("string"), "bom_serial").alias("set_id"), F.col("bom_ref").alias("token"))
    return similar_sets(rows, 0.8).withColumn("jaccard", F.round("jaccard", 9))
