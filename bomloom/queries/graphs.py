"""Queries of the graph operators; the oracle uses recursive CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom import testdata
from bomloom.operators import differ, graph, search
from bomloom.queries.fleetwide import PAIRS, RANK, M

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_ROOTS = ", roots AS (SELECT sbom_id, id FROM components c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.sbom_id = c.sbom_id AND e.to_id = c.id))"
_DEPTH = f"""{_ROOTS},
walk AS (SELECT sbom_id, id, 1 AS depth FROM roots UNION SELECT w.sbom_id, e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.sbom_id = w.sbom_id AND e.from_id = w.id WHERE w.depth < 25),
depths AS (SELECT c.sbom_id, c.id, CAST(coalesce(min(w.depth), 2147483647) AS INTEGER) AS depth FROM components c LEFT JOIN walk w ON w.sbom_id = c.sbom_id AND w.id = c.id GROUP BY 1, 2)"""
_CLOSURE = """,
arcs AS (SELECT DISTINCT sbom_id, from_id, to_id FROM edges),
reach AS (SELECT sbom_id, from_id AS id, to_id AS reached FROM arcs UNION SELECT r.sbom_id, r.id, a.to_id FROM reach r JOIN arcs a ON a.sbom_id = r.sbom_id AND a.from_id = r.reached)"""


@query(f"{M}{_DEPTH} SELECT * FROM depths")
def graph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(testdata.tables(spark, sf_dir, cut=True))


@query(f"{M}{_DEPTH} SELECT sbom_id, id, depth - 1 AS depth FROM depths WHERE depth <= 3")
def graph_depth_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(testdata.tables(spark, sf_dir, cut=True), root_depth=0, max_depth=2, sentinel=None)


@query(
    f"{M}{_CLOSURE}, t AS (SELECT sbom_id, reached AS id, count(*) AS transitive FROM reach GROUP BY 1, 2), d AS (SELECT sbom_id, to_id AS id, count(*) AS direct FROM arcs GROUP BY 1, 2), h AS (SELECT DISTINCT sbom_id, component_id AS id, true AS hit FROM vulns), "
    "f AS (SELECT c.sbom_id, c.id, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(hit, false) AS hit FROM components c LEFT JOIN d USING (sbom_id, id) LEFT JOIN t USING (sbom_id, id) LEFT JOIN h USING (sbom_id, id)) "
    "SELECT sbom_id, id, direct, transitive, CASE WHEN hit AND transitive > 10 THEN 'critical' WHEN hit OR transitive > 20 THEN 'high' WHEN transitive > 5 THEN 'medium' ELSE 'low' END AS risk_level FROM f"
)
def graph_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(testdata.tables(spark, sf_dir, cut=True))


@query(f"{M}{_CLOSURE} SELECT sbom_id, id FROM reach WHERE id = reached")
def graph_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cyclic_nodes(testdata.tables(spark, sf_dir, cut=True))


_ISLANDS = f""",
near AS (SELECT DISTINCT sbom_id, from_id AS a, to_id AS b FROM edges UNION SELECT DISTINCT sbom_id, to_id, from_id FROM edges),
seed AS (SELECT sbom_id, id FROM components WHERE part_no = 0),
big AS (SELECT sbom_id, id FROM seed UNION SELECT g.sbom_id, n.b FROM big g JOIN near n ON n.sbom_id = g.sbom_id AND n.a = g.id),
rest AS (SELECT c.sbom_id, c.id FROM components c WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.sbom_id = c.sbom_id AND b.id = c.id)),
small AS (SELECT sbom_id, id, id AS other FROM rest UNION SELECT s.sbom_id, s.id, n.b FROM small s JOIN near n ON n.sbom_id = s.sbom_id AND n.a = s.other),
islands AS (SELECT sbom_id, id, min(id) OVER (PARTITION BY sbom_id) AS island FROM big UNION ALL SELECT sbom_id, id, min(other) FROM small GROUP BY 1, 2)"""


@query(f"{M}{_ISLANDS} SELECT * FROM islands")
def graph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.islands(testdata.tables(spark, sf_dir, cut=True))


_DEGREES = ", fo AS (SELECT sbom_id, from_id AS id, count(*) AS fan_out FROM edges GROUP BY 1, 2), fi AS (SELECT sbom_id, to_id AS id, count(*) AS fan_in FROM edges GROUP BY 1, 2), deg AS (SELECT sbom_id, CAST(sum(coalesce(fan_out, 0)) AS BIGINT) AS edges, count(*) FILTER (fan_out > 0 AND fan_in IS NULL) AS roots, count(*) FILTER (fan_out IS NULL AND fan_in > 0) AS leaves, count(*) FILTER (fan_out IS NULL AND fan_in IS NULL) AS orphans, max(coalesce(fan_out, 0)) AS max_fan_out FROM components LEFT JOIN fo USING (sbom_id, id) LEFT JOIN fi USING (sbom_id, id) GROUP BY sbom_id)"


@query(f"{M}{_DEGREES} SELECT * FROM deg")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(testdata.tables(spark, sf_dir))


@query(
    f"{M}{_DEPTH}{_CLOSURE}{_ISLANDS}{_DEGREES}, x AS (SELECT sbom_id, deg.edges, deg.roots, max_fan_out, n, islands, coalesce(max_depth, 0) AS max_depth, coalesce(cyclic, 0) AS cyclic FROM deg JOIN (SELECT sbom_id, count(*) AS n FROM components GROUP BY 1) USING (sbom_id) JOIN (SELECT sbom_id, count(DISTINCT island) AS islands FROM islands GROUP BY 1) USING (sbom_id) "
    "LEFT JOIN (SELECT sbom_id, max(depth) AS max_depth FROM depths WHERE depth < 2147483647 GROUP BY 1) USING (sbom_id) LEFT JOIN (SELECT sbom_id, count(*) AS cyclic FROM reach WHERE id = reached GROUP BY 1) USING (sbom_id)) "
    "SELECT sbom_id, edges, roots, islands, max_depth, cyclic, round(100 * (1 - (0.3 * least(ln(1 + edges / n) / ln(20.0), 1) + 0.2 * least(max_depth / 15, 1) + 0.2 * greatest(least((max_fan_out - 1) / 99, 1), 0) + 0.2 * least(cyclic / greatest(1, n * 0.05), 1) + 0.1 * greatest(least((islands - 1) / greatest(n - 1, 1), 1), 0))), 6) AS simplicity FROM x"
)
def graph_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir, cut=True)
    return graph.complexity(t, graph.islands(t), graph.depths(t), graph.cyclic_nodes(t))


def _paired(spark: SparkSession, sf_dir: str):
    t = testdata.tables(spark, sf_dir, cut=True)
    pairs = differ.consecutive_pairs(t)
    return t, pairs, differ.identity_matches(t, pairs)


_SHOW = "CASE WHEN {0} = 2147483647 THEN 'unreachable' ELSE CAST({0} AS VARCHAR) END"


@query(
    f"{M}{PAIRS}{_DEPTH}, d AS (SELECT p.old_sbom, p.new_sbom, n.id, o.depth AS od, n.depth AS nd, EXISTS (SELECT 1 FROM vulns v WHERE v.sbom_id = p.new_sbom AND v.component_id = n.id) AS hit FROM pairs p JOIN depths o ON o.sbom_id = p.old_sbom JOIN depths n ON n.sbom_id = p.new_sbom AND n.id = o.id WHERE o.depth <> n.depth) "
    f"SELECT old_sbom, new_sbom, id, 'depth_changed' AS kind, id AS other_id, {_SHOW.format('od')} || ' -> ' || {_SHOW.format('nd')} AS detail, CASE WHEN nd < od AND hit THEN 'high' WHEN nd <= 2 AND od > 2 THEN 'medium' ELSE 'low' END AS impact FROM d"
)
def graph_depth_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, matches = _paired(spark, sf_dir)
    return graph.depth_changes(t, matches, graph.depths(t))


_CHILD = """,
arc AS (SELECT sbom_id, from_id, to_id, max(relationship || '/' || coalesce(scope, '')) AS attr FROM edges GROUP BY 1, 2, 3),
m AS (SELECT p.old_sbom, p.new_sbom, n.id FROM pairs p JOIN components o ON o.sbom_id = p.old_sbom JOIN components n ON n.sbom_id = p.new_sbom AND n.id = o.id),
oldc AS (SELECT m1.old_sbom, m1.new_sbom, a.from_id AS parent, a.to_id AS child, attr AS old_attr FROM arc a JOIN m m1 ON m1.old_sbom = a.sbom_id AND m1.id = a.from_id JOIN m m2 ON m2.old_sbom = a.sbom_id AND m2.id = a.to_id),
newall AS (SELECT p.old_sbom, p.new_sbom, a.from_id AS parent, a.to_id AS child, attr AS new_attr FROM arc a JOIN pairs p ON p.new_sbom = a.sbom_id),
newc AS (SELECT n.* FROM newall n JOIN m ON m.old_sbom = n.old_sbom AND m.id = n.parent),
joined AS (SELECT coalesce(o.old_sbom, n.old_sbom) AS old_sbom, coalesce(o.new_sbom, n.new_sbom) AS new_sbom, coalesce(o.parent, n.parent) AS id, coalesce(o.child, n.child) AS other_id, old_attr, new_attr FROM oldc o FULL JOIN newc n ON o.old_sbom = n.old_sbom AND o.parent = n.parent AND o.child = n.child),
ranked AS (SELECT j.*, coalesce(d.depth > 0 AND d.depth <= 2, false) AS direct, EXISTS (SELECT 1 FROM vulns v WHERE v.sbom_id = j.new_sbom AND v.component_id = j.other_id) AS hit FROM joined j LEFT JOIN depths d ON d.sbom_id = j.new_sbom AND d.id = j.other_id),
kinds AS (SELECT old_sbom, new_sbom, id, CASE WHEN old_attr IS NULL THEN 'dependency_added' WHEN new_attr IS NULL THEN 'dependency_removed' WHEN old_attr <> new_attr THEN 'relationship_changed' END AS kind, other_id, CASE WHEN old_attr <> new_attr THEN old_attr || ' -> ' || new_attr ELSE '' END AS detail,
  CASE WHEN old_attr IS NULL THEN CASE WHEN hit AND direct THEN 'critical' WHEN hit THEN 'high' WHEN direct THEN 'medium' ELSE 'low' END WHEN new_attr IS NULL THEN 'low' ELSE 'medium' END AS impact FROM ranked),
lost AS (SELECT old_sbom, new_sbom, other_id AS child, min(id) AS was FROM kinds WHERE kind = 'dependency_removed' GROUP BY 1, 2, 3),
got AS (SELECT n.old_sbom, n.new_sbom, n.child, min(n.parent) AS now FROM newall n JOIN m ON m.old_sbom = n.old_sbom AND m.id = n.child WHERE NOT EXISTS (SELECT 1 FROM oldc o WHERE o.old_sbom = n.old_sbom AND o.parent = n.parent AND o.child = n.child) GROUP BY 1, 2, 3),
moved AS (SELECT * FROM lost JOIN got USING (old_sbom, new_sbom, child)),
dep AS (SELECT * FROM kinds k WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM moved x WHERE x.old_sbom = k.old_sbom AND x.child = k.other_id AND ((k.kind = 'dependency_added' AND k.id = x.now) OR (k.kind = 'dependency_removed' AND k.id = x.was)))
  UNION ALL SELECT old_sbom, new_sbom, child, 'reparented', child, was || ' -> ' || now, 'medium' FROM moved)"""


@query(f"{M}{PAIRS}{_DEPTH}{_CHILD} SELECT * FROM dep")
def graph_child_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, matches = _paired(spark, sf_dir)
    return graph.dependency_diff(t, pairs, matches, graph.depths(t)).where("kind <> 'depth_changed'")


@query(f"{M}{PAIRS}{_DEPTH}{_CHILD} SELECT old_sbom, new_sbom, kind, impact, count(*) AS n FROM dep GROUP BY 1, 2, 3, 4")
def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pairs, matches = _paired(spark, sf_dir)
    return graph.impact_summary(graph.dependency_diff(t, pairs, matches, graph.depths(t)).where("kind <> 'depth_changed'"))


@query(
    f"{M}{_ROOTS}, arcs AS (SELECT DISTINCT sbom_id, from_id, to_id FROM edges), start AS (SELECT sbom_id, id FROM roots r WHERE EXISTS (SELECT 1 FROM edges e WHERE e.sbom_id = r.sbom_id AND e.from_id = r.id)), "
    "ways AS (SELECT sbom_id, id AS root, id, id AS way, 0 AS hops FROM start UNION ALL SELECT w.sbom_id, w.root, a.to_id, w.way || '>' || a.to_id, w.hops + 1 FROM ways w JOIN arcs a ON a.sbom_id = w.sbom_id AND a.from_id = w.id WHERE w.hops < 5), "
    "best AS (SELECT sbom_id, root, id, min(hops) AS hops, arg_min(way, (hops, way)) AS way FROM ways GROUP BY 1, 2, 3) SELECT sbom_id, root, id, hops, way, CASE WHEN hops <= 1 THEN 100 WHEN hops = 2 THEN 90 WHEN hops = 3 THEN 70 WHEN hops = 4 THEN 50 ELSE 30 END AS risk FROM best b WHERE hops > 0 AND EXISTS (SELECT 1 FROM vulns v WHERE v.sbom_id = b.sbom_id AND v.component_id = b.id)"
)
def graph_attack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.attack_paths(testdata.tables(spark, sf_dir, cut=True))


@query(f"{M} SELECT *, 'dependency' AS role FROM edges WHERE from_id IN ('part:3', 'part:21') UNION ALL SELECT *, 'dependent' FROM edges WHERE to_id IN ('part:3', 'part:21')")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(testdata.tables(spark, sf_dir), ["part:3", "part:21"])


@query(
    f"{M}{_CLOSURE}, t AS (SELECT sbom_id, reached AS component_id, count(*) AS n FROM reach GROUP BY 1, 2), u AS (SELECT v.sbom_id, v.component_id, v.vuln_id, CAST(least({RANK} * 10 + floor(coalesce(cvss, 0) * 3) + CASE WHEN n > 50 THEN 20 WHEN n > 20 THEN 15 WHEN n > 10 THEN 10 WHEN n > 0 THEN 5 ELSE 0 END, 100) AS INTEGER) AS urgency FROM vulns v LEFT JOIN t USING (sbom_id, component_id)) "
    "SELECT *, 1 AS rank_in_component FROM u QUALIFY row_number() OVER (PARTITION BY sbom_id, component_id ORDER BY urgency DESC, vuln_id) = 1"
)
def ui_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir, cut=True)
    return search.urgency(t, graph.blast_radius(t)).where(F.col("rank_in_component") == 1)


@query(f"{M}{PAIRS}{_DEPTH}{_CHILD} SELECT * FROM dep WHERE impact IN ('medium', 'high', 'critical')")
def graph_impact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.at_least(graph_child_diff(spark, sf_dir), "medium")


@query(f"{M} SELECT * FROM edges WHERE relationship IN ('depends-on', 'dev-depends-on')")
def graph_relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(testdata.tables(spark, sf_dir).edges, ["Depends-On", "DEV-depends-on"])
