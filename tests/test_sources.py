import json
import tempfile

from pyspark.sql import functions as F

from bomloom.operators import differ, enrichment, graph
from bomloom.sources import documents, sinks
from bomloom.streaming import watch

CDX = {
    "bomFormat": "CycloneDX", "specVersion": "1.5", "metadata": {"component": {"name": "app", "version": "1"}},
    "components": [{"bom-ref": "a", "name": "a", "version": "1.0.0", "purl": "pkg:npm/a@1.0.0", "licenses": [{"license": {"id": "MIT"}}]}, {"bom-ref": "b", "name": "b", "licenses": [{"expression": "MIT OR GPL-2.0"}]}],
    "dependencies": [{"ref": "a", "dependsOn": ["b", "ghost"]}], "vulnerabilities": [{"id": "CVE-1", "ratings": [{"score": 9.8}], "affects": [{"ref": "a"}, {"ref": "b"}]}],
}
TAGS = """SPDXVersion: SPDX-2.3
SPDXID: SPDXRef-DOCUMENT
PackageName: p
SPDXID: SPDXRef-p
PackageVersion: 1.0
PackageSupplier: Organization: Corp
PackageLicenseDeclared: NOASSERTION
PackageLicenseConcluded: MIT
ExternalRef: PACKAGE-MANAGER purl pkg:npm/p@1.0
PackageName: q
SPDXID: SPDXRef-q
Relationship: SPDXRef-q DEPENDENCY_OF SPDXRef-p
Relationship: SPDXRef-q WHATEVER SPDXRef-p
"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://spdx.org/rdf/terms#"><SpdxDocument rdf:about="http://x#SPDXRef-DOCUMENT">
<Package rdf:about="http://x#SPDXRef-p"><name>p</name><versionInfo>1.0</versionInfo><relationship><Relationship><relationshipType rdf:resource="http://spdx.org/rdf/terms#relationshipType_dependsOn"/><relatedSpdxElement rdf:resource="http://x#SPDXRef-q"/></Relationship></relationship></Package>
<Package rdf:about="http://x#SPDXRef-q"><name>q</name></Package></SpdxDocument></rdf:RDF>"""
XML = '<bom xmlns="http://cyclonedx.org/schema/bom/1.5" version="1"><components><component type="library" bom-ref="a"><name>a</name><version>1</version></component><component type="library"><name>b</name></component></components></bom>'


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t if isinstance(t, (str, type(None))) else json.dumps(t)) for i, t in enumerate(texts)], "sbom_id string, text string")


def test_cyclonedx(spark):
    t = documents.cyclonedx_json(docs(spark, CDX, "{broken", None))
    assert {(r.id, r.licence) for r in t.components.collect()} == {("app@1", None), ("pkg:npm/a@1.0.0", "MIT"), ("b", "MIT OR GPL-2.0")}
    assert [(r.from_id, r.to_id) for r in t.edges.collect()] == [("pkg:npm/a@1.0.0", "b")]
    assert {(r.component_id, r.severity) for r in t.vulns.collect()} == {("pkg:npm/a@1.0.0", "critical"), ("b", "critical")}
    assert {r.name for r in documents.cyclonedx_xml(docs(spark, XML)).collect()} == {"a", "b"}


def test_spdx(spark):
    t = documents.spdx_tag_value(docs(spark, TAGS))
    assert {(r.id, r.supplier, r.licence) for r in t.components.collect()} == {("pkg:npm/p@1.0", "Corp", "MIT"), ("q", None, None)}
    assert [(r.from_id, r.to_id) for r in t.edges.collect()] == [("pkg:npm/p@1.0", "q")]
    r = documents.spdx_rdf(docs(spark, RDF, "<broken"))
    assert {x.id for x in r.components.collect()} == {"p@1.0", "q"} and [(x.from_id, x.to_id) for x in r.edges.collect()] == [("p@1.0", "q")]
    j = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "p", "name": "p"}, {"SPDXID": "q", "name": "q"}], "relationships": [{"spdxElementId": "p", "relationshipType": "DEPENDS_ON", "relatedSpdxElement": "q"}]}
    assert documents.spdx_json(docs(spark, j)).edges.count() == 1


def test_detect_and_vex(spark):
    found = {r.sbom_id: (r.d.format, r.d.variant) for r in docs(spark, CDX, XML, TAGS, RDF, "hello", "").select("sbom_id", documents.detect(F.col("text")).alias("d")).collect()}
    assert found == {"0": ("cyclonedx", "json"), "1": ("cyclonedx", "xml"), "2": ("spdx", "tag-value"), "3": ("spdx", "rdf"), "4": ("unknown", None), "5": ("unknown", None)}
    vex = {"statements": [{"vulnerability": {"name": "V", "aliases": ["W"]}, "status": "odd"}, {"vulnerability": {"name": "V"}, "status": "fixed", "products": [{"identifiers": {"purl": "pkg:npm/a@1.0.0"}}]}]}
    s = documents.openvex(docs(spark, vex))
    assert {(r.vuln_id, r.status, r.purl) for r in s.collect()} == {("V", "under_investigation", None), ("W", "under_investigation", None), ("V", "fixed", "pkg:npm/a@1.0.0")}
    t = documents.cyclonedx_json(docs(spark, CDX))
    v = t.vulns.withColumn("vuln_id", F.lit("V"))
    assert {r.vex_status for r in enrichment.with_vex(v, t.components, s).collect()} == {"fixed", "under_investigation"}


def test_diff_of_a_document_with_itself_is_empty(spark):
    t = documents.cyclonedx_json(docs(spark, CDX))
    pairs = spark.createDataFrame([("0", "0")], "old_sbom string, new_sbom string")
    m = differ.identity_matches(t, pairs)
    assert differ.component_changes(t, pairs, m).count() == differ.edge_changes(t, pairs, m).count() == 0


def test_graph_with_cycle_loop_and_island(spark):
    from bomloom.model import Tables

    c = spark.createDataFrame([(1, x) for x in "abcdefg"], "sbom_id int, id string")
    e = spark.createDataFrame([(1, a, b, "d", None) for a, b in ("ab", "bc", "cb", "de", "ed", "ff")], "sbom_id int, from_id string, to_id string, relationship string, scope string")
    v = spark.createDataFrame([(1, "c", "V", 9.0)], "sbom_id int, component_id string, vuln_id string, cvss double")
    t = Tables(c, e, v)
    depth = {r.id: r.depth for r in graph.depths(t).collect()}
    assert depth == {"a": 1, "b": 2, "c": 3, "d": graph.CYCLIC, "e": graph.CYCLIC, "f": graph.CYCLIC, "g": 1}
    assert {r.id: r.island for r in graph.islands(t).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert {r.id for r in graph.cyclic_nodes(t).collect()} == set("bcdef")
    assert {r.id: r.transitive for r in graph.blast_radius(t).collect()} == {"a": 0, "b": 3, "c": 3, "d": 2, "e": 2, "f": 1, "g": 0}


def test_reports(spark):
    rows = spark.createDataFrame([("s", "R1", "high", 'a "b"'), ("s", "R2", "low", "c")], "sbom_id string, rule_id string, severity string, message string")
    report = json.loads(sinks.sarif(rows).first().sarif)
    assert [r["level"] for r in report["runs"][0]["results"]] == ["error", "note"]
    with tempfile.TemporaryDirectory() as d:
        sinks.write_ndjson(f"{d}/n", a=rows)
        sinks.write_csv(f"{d}/c", a=rows)
        assert spark.read.json(f"{d}/n").count() == 2 and spark.read.csv(f"{d}/c/a", header=True).count() == 2
    assert "a \\| b" in sinks.markdown_table(spark.createDataFrame([("a | b",)], "x string"), ["x"])


def test_watching_a_folder(spark, tmp_path):
    seen = []

    def step():
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp"), lambda d: documents.cyclonedx_json(d), lambda c: seen.extend((r.kind, r.id) for r in c.collect())).awaitTermination()
        out = sorted(seen)
        seen.clear()
        return out

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(CDX))
    assert step() == [("added", "app@1"), ("added", "b"), ("added", "pkg:npm/a@1.0.0")]
    assert step() == []
    changed = {**CDX, "components": [*CDX["components"][:1], {"name": "c"}]}
    (tmp_path / "in" / "a2.json").write_text("{broken")
    (tmp_path / "in" / "b.json").write_text(json.dumps(changed))
    assert step() == [("added", "app@1"), ("added", "c"), ("added", "pkg:npm/a@1.0.0")]
    left = spark.createDataFrame([("x",)], "sbom_id string")
    assert watch.removed_files(spark, str(tmp_path / "state"), left).count() == 2
