"""Documents as text to relational tables: format detection, CycloneDX, SPDX and OpenVEX."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomloom.functions.jsontext import leaf_text, parse, storable
from bomloom.model import Tables, severity_of
from bomloom.operators.shredding import unwrap

_LICENCE = "array<struct<license: struct<id: string, name: string>, expression: string>>"
CYCLONEDX = f"""bomFormat string, specVersion string, serialNumber string,
 metadata struct<timestamp: string, component: struct<type: string, `bom-ref`: string, name: string, version: string, purl: string>>,
 components array<struct<type: string, `bom-ref`: string, name: string, version: string, purl: string, description: string, scope: string, supplier: struct<name: string>,
  licenses: {_LICENCE}, hashes: array<struct<alg: string, content: string>>>>,
 dependencies array<struct<ref: string, dependsOn: array<string>>>,
 vulnerabilities array<struct<id: string, ratings: array<struct<score: double, severity: string>>, affects: array<struct<ref: string>>>>"""
SPDX = """spdxVersion string, SPDXID string, name string, documentNamespace string,
 packages array<struct<SPDXID: string, name: string, versionInfo: string, supplier: string, licenseConcluded: string, licenseDeclared: string, downloadLocation: string,
  externalRefs: array<struct<referenceCategory: string, referenceType: string, referenceLocator: string>>, checksums: array<struct<algorithm: string, checksumValue: string>>>>,
 relationships array<struct<spdxElementId: string, relationshipType: string, relatedSpdxElement: string>>"""
OPENVEX = """`@id` string, author string, timestamp string, statements array<struct<vulnerability: struct<name: string, aliases: array<string>>, status: string,
 products: array<struct<`@id`: string, identifiers: struct<purl: string>>>, justification: string>>"""

# SPDX relationships that are dependencies; True swaps the direction.
RELATIONSHIPS = {
    "DEPENDS_ON": ("depends-on", False), "DEPENDENCY_OF": ("depends-on", True), "DEV_DEPENDENCY_OF": ("dev-depends-on", True), "BUILD_DEPENDENCY_OF": ("build-depends-on", True),
    "TEST_DEPENDENCY_OF": ("test-depends-on", True), "RUNTIME_DEPENDENCY_OF": ("runtime-depends-on", True), "OPTIONAL_DEPENDENCY_OF": ("optional-depends-on", True), "PROVIDED_DEPENDENCY_OF": ("provided-depends-on", True),
    "CONTAINS": ("contains", False), "CONTAINED_BY": ("contains", True), "STATIC_LINK": ("static-link", False), "DYNAMIC_LINK": ("dynamic-link", False), "GENERATES": ("generates", False), "GENERATED_FROM": ("generates", True),
    "ANCESTOR_OF": ("ancestor-of", False), "DESCENDANT_OF": ("ancestor-of", True), "VARIANT_OF": ("variant-of", False), "PATCH_FOR": ("patch-for", False), "COPY_OF": ("copy-of", False), "DESCRIBES": ("describes", False),
}
_NOTHING = ("NOASSERTION", "NONE", "")


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``sbom_id`` (the path) and ``text``, a row for each file."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.input_file_name().alias("sbom_id"), F.col("value").alias("text"))


def detect(text: Column) -> Column:
    """STRUCT<format, variant, confidence>: cyclonedx, spdx or unknown, by scored marks; a tie is SPDX."""
    has = lambda s: F.coalesce(text.contains(s), F.lit(False))
    score = lambda *marks: F.least(sum((F.when(has(m), w).otherwise(0.0) for m, w in marks), F.lit(0.0)), F.lit(1.0))
    first = F.substring(F.ltrim(text), 1, 1)
    cdx = F.when(first == "<", score(("cyclonedx.org/schema/bom", 0.9), ("<bom", 0.1))).otherwise(score(('"bomFormat"', 0.5), ("CycloneDX", 0.3), ('"specVersion"', 0.2)))
    spdx = F.when(first == "<", score(("spdx.org/rdf/terms", 0.9), ("SpdxDocument", 0.1))).when(first == "{", score(('"spdxVersion"', 0.5), ('"SPDXID"', 0.3), ("SPDX-", 0.2))).otherwise(score(("SPDXVersion:", 0.7), ("SPDXID:", 0.3)))
    best = F.greatest(cdx, spdx)
    name = F.when(best < 0.25, "unknown").when(cdx > spdx, "cyclonedx").otherwise("spdx")
    variant = F.when(best < 0.25, None).when(first == "{", "json").when(first == "<", F.when(cdx > spdx, "xml").otherwise("rdf")).otherwise("tag-value")
    return F.struct(name.alias("format"), variant.alias("variant"), F.when(best < 0.25, 0.0).otherwise(best).alias("confidence"))


def _last(components: DataFrame) -> DataFrame:
    """One row for each id of a document: the last one written stands."""
    cols = [c for c in components.columns if c not in ("sbom_id", "id", "pos")]
    return components.groupBy("sbom_id", "id").agg(F.max_by(F.struct(*cols), "pos").alias("c")).select("sbom_id", "id", "c.*")


def _identified(purl: Column, name: Column, version: Column) -> Column:
    return F.coalesce(F.lower(purl), F.concat(name, F.coalesce(F.concat(F.lit("@"), version), F.lit(""))))


def cyclonedx_json(docs: DataFrame) -> Tables:
    """Components (the primary one included), resolved dependencies and vulnerabilities of CycloneDX JSON texts.

    References that name no component are dropped.  A rating's severity counts
    first, else the band of the highest score.  Texts that don't parse have no rows.
    """
    d = docs.select("sbom_id", F.from_json("text", CYCLONEDX).alias("d")).where("d.bomFormat is not null")
    own = F.struct(*[F.col(f"d.metadata.component.{c}").alias(c) for c in ("bom-ref", "name", "version", "purl")], *[F.lit(None).cast("string").alias(c) for c in ("description", "supplier", "licence", "hash")])
    item = lambda c: F.struct(
        *[c[x].alias(x) for x in ("bom-ref", "name", "version", "purl", "description")], c["supplier"]["name"].alias("supplier"),
        F.get(F.transform(c["licenses"], lambda x: F.coalesce(x["license"]["id"], x["license"]["name"], x["expression"])), F.lit(0)).alias("licence"), F.get(c["hashes"], F.lit(0))["content"].alias("hash"),
    )
    listed = F.transform(F.coalesce("d.components", F.array()), item)
    rows = d.select("sbom_id", F.posexplode(F.concat(F.filter(F.array(own), lambda x: x["name"].isNotNull()), listed)).alias("pos", "c")).select("sbom_id", "pos", "c.*")
    named = rows.withColumn("id", _identified(F.col("purl"), F.col("name"), F.col("version"))).withColumn("ref", F.coalesce("bom-ref", "name")).where("id is not null")
    refs = named.groupBy("sbom_id", "ref").agg(F.max_by("id", "pos").alias("id"))
    comps = _last(named.drop("bom-ref", "ref")).withColumn("ecosystem", F.regexp_extract("purl", "^pkg:([^/]+)", 1))
    arcs = d.select("sbom_id", F.explode("d.dependencies").alias("x")).select("sbom_id", F.col("x.ref").alias("ref"), F.explode("x.dependsOn").alias("to_ref"))
    edges = arcs.join(refs.withColumnRenamed("id", "from_id"), ["sbom_id", "ref"]).join(refs.select("sbom_id", F.col("ref").alias("to_ref"), F.col("id").alias("to_id")), ["sbom_id", "to_ref"])
    found = d.select("sbom_id", F.explode("d.vulnerabilities").alias("v")).select("sbom_id", F.col("v.id").alias("vuln_id"), F.col("v.ratings").alias("r"), F.explode("v.affects").alias("a"))
    cvss = F.array_max(F.transform("r", lambda x: x["score"]))
    severity = F.coalesce(F.get(F.filter(F.transform("r", lambda x: F.lower(x["severity"])), lambda s: s.isNotNull()), F.lit(0)), severity_of(cvss))
    vulns = found.select("sbom_id", "vuln_id", cvss.alias("cvss"), severity.alias("severity"), F.col("a.ref").alias("ref")).join(refs.withColumnRenamed("id", "component_id"), ["sbom_id", "ref"])
    return Tables(
        comps.select("sbom_id", "id", "name", "version", "ecosystem", "supplier", "licence", "purl", "description", "hash"),
        edges.select("sbom_id", "from_id", "to_id", F.lit("depends-on").alias("relationship"), F.lit(None).cast("string").alias("scope")),
        vulns.select("sbom_id", "component_id", "vuln_id", "cvss", "severity", F.lit(None).cast("date").alias("published")),
    )


def cyclonedx_xml(docs: DataFrame) -> DataFrame:
    """Components of CycloneDX XML texts, by the published element names."""
    schema = "components struct<component: array<struct<`_type`: string, `_bom-ref`: string, name: string, version: string, purl: string, description: string>>>"
    rows = docs.select("sbom_id", F.from_xml("text", schema, {"rowTag": "bom"}).alias("d")).select("sbom_id", F.posexplode("d.components.component").alias("pos", "c"))
    named = rows.select("sbom_id", "pos", "c.name", "c.version", "c.purl", "c.description").withColumn("id", _identified(F.col("purl"), F.col("name"), F.col("version")))
    return _last(named.where("id is not null"))


def _spdx_tables(packages: DataFrame, relations: DataFrame) -> Tables:
    """From ``sbom_id, pos, spdxid, name, version, supplier, declared, concluded, purl, hash`` and ``sbom_id, a, kind, b``."""
    asserted = lambda c: F.when(~F.col(c).isin(*_NOTHING), F.col(c))
    named = packages.withColumn("id", _identified(F.col("purl"), F.col("name"), F.col("version"))).where("id is not null")
    refs = named.where("spdxid is not null").groupBy("sbom_id", "spdxid").agg(F.max_by("id", "pos").alias("id"))
    comps = named.select("sbom_id", "id", "pos", "name", "version", F.regexp_extract("purl", "^pkg:([^/]+)", 1).alias("ecosystem"), F.regexp_replace(asserted("supplier"), r"^(?:Organization|Person):\s*", "").alias("supplier"), F.coalesce(asserted("declared"), asserted("concluded")).alias("licence"), "purl", F.lit(None).cast("string").alias("description"), "hash")
    kinds = F.create_map(*[F.lit(x) for k, (v, _) in RELATIONSHIPS.items() for x in (k, v)])
    swaps = F.create_map(*[F.lit(x) for k, (_, s) in RELATIONSHIPS.items() for x in (k, s)])
    ends = relations.withColumn("rel", kinds[F.col("kind")]).where("rel is not null").withColumn("swap", swaps[F.col("kind")])
    ends = ends.select("sbom_id", "rel", F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("x"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("y"))
    edges = ends.join(refs.select("sbom_id", F.col("spdxid").alias("x"), F.col("id").alias("from_id")), ["sbom_id", "x"]).join(refs.select("sbom_id", F.col("spdxid").alias("y"), F.col("id").alias("to_id")), ["sbom_id", "y"])
    none = comps.limit(0).select("sbom_id", F.col("id").alias("component_id"), F.col("name").alias("vuln_id"), F.lit(None).cast("double").alias("cvss"), F.col("name").alias("severity"), F.lit(None).cast("date").alias("published"))
    return Tables(_last(comps), edges.select("sbom_id", "from_id", "to_id", F.col("rel").alias("relationship"), F.lit(None).cast("string").alias("scope")), none)


#: Fields that mark a document, and the arrays that ``spdx_json`` and ``openvex`` read, outer ones first.
MARKERS = ("packages", "statements", "spdxVersion", "@context")
ARRAYS = (("packages",), ("packages", "externalRefs"), ("packages", "checksums"), ("relationships",), ("statements",), ("statements", "products"), ("statements", "vulnerability", "aliases"))


def _listed(obj: dict, path: tuple[str, ...]) -> bool:
    """Puts the value at ``path`` into a list if it isn't in one; whether anything changed."""
    key, rest = path[0], path[1:]
    value = obj.get(key)
    if value is None:
        return False
    if not rest:
        if not isinstance(value, list):
            obj[key] = [value]
        return not isinstance(value, list)
    return any([_listed(x, rest) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)])


def _plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        texts = []
        for text in pdf["text"]:
            doc = parse(text)
            bare = unwrap(doc, MARKERS)
            if bare is not None and any([bare is not doc, *[_listed(bare, p) for p in ARRAYS]]):
                text = json.dumps(bare)
            texts.append(text)
        yield pdf.assign(text=texts)


def plain_json(docs: DataFrame) -> DataFrame:
    """``docs`` as the published schemas have them: taken out of a wrapping object, an only element inside its array.

    Texts that need neither, and those that are no JSON, stay as they are.
    """
    return docs.select("sbom_id", "text").mapInPandas(_plain, docs.select("sbom_id", "text").schema)


def spdx_json(docs: DataFrame) -> Tables:
    """Packages and relationships of SPDX JSON texts; unknown relationships are dropped."""
    d = docs.select("sbom_id", F.from_json("text", SPDX).alias("d"))
    p = d.select("sbom_id", F.posexplode("d.packages").alias("pos", "p"))
    purl = F.get(F.filter(F.col("p.externalRefs"), lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]
    packages = p.select("sbom_id", "pos", F.col("p.SPDXID").alias("spdxid"), "p.name", F.col("p.versionInfo").alias("version"), "p.supplier", F.col("p.licenseDeclared").alias("declared"), F.col("p.licenseConcluded").alias("concluded"), purl.alias("purl"), F.get("p.checksums", F.lit(0))["checksumValue"].alias("hash"))
    r = d.select("sbom_id", F.explode("d.relationships").alias("r")).select("sbom_id", F.col("r.spdxElementId").alias("a"), F.col("r.relationshipType").alias("kind"), F.col("r.relatedSpdxElement").alias("b"))
    return _spdx_tables(packages, r)


def spdx_tag_value(docs: DataFrame) -> Tables:
    """SPDX tag-value texts: each ``PackageName`` line starts a package, the lines up to the next one are its fields."""
    lines = docs.select("sbom_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).where(F.col("raw").contains(":"))
    kv = lines.select("sbom_id", "line", F.trim(F.regexp_extract("raw", r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract("raw", r"^[^:]+:(.*)$", 1)).alias("v"))
    w = Window.partitionBy("sbom_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = kv.withColumn("pos", F.sum((F.col("k") == "PackageName").cast("int")).over(w))
    pick = lambda key, how=F.col("v"): F.max_by(F.when(F.col("k") == key, how), F.when(F.col("k") == key, F.col("line")))
    purl = F.max(F.when((F.col("k") == "ExternalRef") & F.col("v").contains(" purl "), F.regexp_extract("v", r"\spurl\s+(\S+)", 1)))
    packages = marked.where("pos > 0 and k <> 'Relationship'").groupBy("sbom_id", "pos").agg(pick("SPDXID").alias("spdxid"), pick("PackageName").alias("name"), pick("PackageVersion").alias("version"), pick("PackageSupplier").alias("supplier"), pick("PackageLicenseDeclared").alias("declared"), pick("PackageLicenseConcluded").alias("concluded"), purl.alias("purl"), pick("PackageChecksum", F.regexp_extract("v", r":\s*(\S+)$", 1)).alias("hash"))
    r = kv.where("k = 'Relationship'").withColumn("w", F.split("v", r"\s+")).where(F.size("w") >= 3).select("sbom_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("kind"), F.col("w")[2].alias("b"))
    return _spdx_tables(packages, r)


def _rdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s, r = "{http://spdx.org/rdf/terms#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    local = lambda u: (u or "").rsplit("#", 1)[-1].rsplit("/", 1)[-1]
    for pdf in frames:
        out = []
        for doc, text in zip(pdf["sbom_id"], pdf["text"], strict=True):
            try:
                root = ET.fromstring(text)
            except (ET.ParseError, TypeError):
                continue
            for pos, p in enumerate(root.iter(f"{s}Package")):
                get = lambda tag, p=p: (p.findtext(f"{s}{tag}") or None)
                res = lambda tag, p=p: next((local(x.get(f"{r}resource")) for x in p.findall(f"{s}{tag}") if x.get(f"{r}resource")), None)
                purl = next((x.text for x in p.iter(f"{s}referenceLocator") if (x.text or "").startswith("pkg:")), None)
                out.append((doc, "p", pos, local(p.get(f"{r}about")), get("name"), get("versionInfo"), get("supplier"), get("licenseDeclared") or res("licenseDeclared"), get("licenseConcluded") or res("licenseConcluded"), purl, p.findtext(f".//{s}checksumValue"), None, None))
            for owner in root.iter():
                for rel in owner.findall(f"{s}relationship/{s}Relationship"):
                    kind = next((local(x.get(f"{r}resource")) for x in rel.findall(f"{s}relationshipType")), "")
                    other = next((x.get(f"{r}resource") or next((y.get(f"{r}about") for y in x), None) for x in rel.findall(f"{s}relatedSpdxElement")), None)
                    out.append((doc, "r", 0, local(owner.get(f"{r}about")), None, None, None, None, None, None, None, kind.replace("relationshipType_", "").upper() if kind.isupper() or "_" not in kind else _camel(kind), local(other)))
        yield pd.DataFrame(out, columns=["sbom_id", "what", "pos", "spdxid", "name", "version", "supplier", "declared", "concluded", "purl", "hash", "kind", "b"])


def _camel(kind: str) -> str:
    name = kind.replace("relationshipType_", "")
    return "".join("_" + c if c.isupper() else c for c in name).upper().lstrip("_")


def spdx_rdf(docs: DataFrame) -> Tables:
    """SPDX RDF/XML texts through the standard XML parser; texts that don't parse have no rows."""
    key = docs.schema["sbom_id"].dataType.simpleString()
    rows = docs.select("sbom_id", "text").mapInPandas(_rdf, f"sbom_id {key}, what string, pos int, spdxid string, name string, version string, supplier string, declared string, concluded string, purl string, hash string, kind string, b string")
    return _spdx_tables(rows.where("what = 'p'").drop("what", "kind", "b"), rows.where("what = 'r'").select("sbom_id", F.col("spdxid").alias("a"), "kind", "b"))


def openvex(docs: DataFrame) -> DataFrame:
    """``sbom_id, seq, vuln_id, status, purl``: a row for each statement, vulnerability name or alias, and product.

    A statement without products holds for all of them (null purl); a product is
    known by its purl, else by its id; an unknown status is under_investigation.
    """
    single = "statements array<struct<products: struct<`@id`: string, identifiers: struct<purl: string>>>>"  # an object in place of the array
    d = docs.select("sbom_id", F.from_json("text", OPENVEX)["statements"].alias("many"), F.from_json("text", single)["statements"].alias("one"))
    s = d.select("sbom_id", F.posexplode(F.arrays_zip("many", "one")).alias("seq", "z"))
    s = s.select("sbom_id", "seq", F.col("z.many").withField("products", F.coalesce("z.many.products", F.when(F.col("z.one.products").isNotNull(), F.array("z.one.products")))).alias("s"))
    names = F.filter(F.array_distinct(F.concat(F.array(F.col("s.vulnerability.name")), F.coalesce("s.vulnerability.aliases", F.array()))), lambda n: n.isNotNull())
    status = F.when(F.col("s.status").isin("not_affected", "affected", "fixed"), F.col("s.status")).otherwise("under_investigation")
    products = F.transform("s.products", lambda p: F.coalesce(p["identifiers"]["purl"], p["@id"]))
    rows = s.select("sbom_id", "seq", status.alias("status"), F.explode(names).alias("vuln_id"), F.when(F.size("s.products") > 0, products).otherwise(F.array(F.lit(None).cast("string"))).alias("ps"))
    return rows.select("sbom_id", "seq", "vuln_id", "status", F.explode("ps").alias("purl"))


def with_sidecar(documents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Fill missing document fields from a side table by ``sbom_id``; given values stay."""
    shared = [c for c in sidecar.columns if c != "sbom_id" and c in documents.columns]
    side = sidecar.select("sbom_id", *[F.col(c).alias(f"side_{c}") for c in shared])
    joined = documents.join(side, "sbom_id", "left")
    return joined.select(*[F.coalesce(c, f"side_{c}").alias(c) if c in shared else c for c in documents.columns])


_TREE = "doc_id bigint, place int, depth int, path string, kind string, value string"


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds = ((dict, "object"), (list, "array"), (str, "string"), (bool, "boolean"))
    for pdf in frames:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["body"], strict=True):
            doc = parse(text)
            if doc is None and (text is None or text.strip() != "null"):
                continue
            stack: list[tuple] = [("$", 0, doc)]
            place = 0
            while stack:
                path, depth, value = stack.pop()
                kind = next((k for t, k in kinds if isinstance(value, t)), "null" if value is None else "number")
                own = None if kind in ("object", "array", "null") else leaf_text(value)
                out.append((doc_id, place, depth, storable(path), kind, own))
                place += 1
                if isinstance(value, dict):
                    stack += [(f"{path}.{k}", depth + 1, v) for k, v in reversed(value.items())]
                elif isinstance(value, list):
                    stack += [(f"{path}[{i}]", depth + 1, v) for i, v in reversed(list(enumerate(value)))]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["doc_id", "place", "depth", "path", "kind", "value"])
                out = []
        yield pd.DataFrame(out, columns=["doc_id", "place", "depth", "path", "kind", "value"])


def flattened(docs: DataFrame) -> DataFrame:
    """Every value of JSON texts (``doc_id, body``), depth first: ``doc_id, place, depth, path, kind, value``; texts that are no JSON have no rows."""
    return docs.select("doc_id", "body").mapInPandas(_walk, _TREE)
