"""Queries of sources, sinks, streams and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom import testdata
from bomloom.operators import differ, quality
from bomloom.queries.fleetwide import CHANGES, PAIRS, M
from bomloom.runtime import shared_dir, table
from bomloom.sources import documents, sinks
from bomloom.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nested_docs").select(F.col("raw_id").alias("sbom_id"), F.col("body").alias("text"))


@query(
    """WITH s AS (SELECT raw_id, body, CASE WHEN contains(body, '"spdxVersion"') THEN 0.5 ELSE 0 END + CASE WHEN contains(body, '"SPDXID"') THEN 0.3 ELSE 0 END + CASE WHEN contains(body, 'SPDX-') THEN 0.2 ELSE 0 END AS spdx,
  CASE WHEN contains(body, '"bomFormat"') THEN 0.5 ELSE 0 END + CASE WHEN contains(body, 'CycloneDX') THEN 0.3 ELSE 0 END + CASE WHEN contains(body, '"specVersion"') THEN 0.2 ELSE 0 END AS cdx FROM nested_docs)
SELECT raw_id AS sbom_id, CASE WHEN greatest(cdx, spdx) < 0.25 THEN 'unknown' WHEN cdx > spdx THEN 'cyclonedx' ELSE 'spdx' END AS format, CASE WHEN greatest(cdx, spdx) >= 0.25 THEN 'json' END AS variant, CAST(CASE WHEN greatest(cdx, spdx) < 0.25 THEN 0 ELSE greatest(cdx, spdx) END AS DOUBLE) AS confidence FROM s"""
)
def src_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("sbom_id", documents.detect(F.col("text")).alias("d")).select("sbom_id", "d.*")


#: Every valid document, taken out of its wrapping object as P5_SQL does; a single object in place of an array is its only element.
_BARE = """docs AS (SELECT raw_id, CASE WHEN json_extract(j, '$.packages') IS NOT NULL OR json_extract(j, '$.statements') IS NOT NULL OR json_extract(j, '$.spdxVersion') IS NOT NULL THEN j
  ELSE coalesce(json_extract(j, '$.document'), json_extract(j, '$.payload'), json_extract(j, '$.sbom'), j) END AS d FROM (SELECT raw_id, body::JSON AS j FROM nested_docs WHERE json_valid(body)))"""


def _listed_sql(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') WHEN json_type({x}) = 'OBJECT' THEN [{x}] ELSE [] END"


@query(
    f"""WITH {_BARE}, v AS (SELECT raw_id, {_listed_sql("json_extract(d, '$.packages')")} AS ps FROM docs),
p AS (SELECT raw_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM v),
q AS (SELECT raw_id, pos, p->>'$.name' AS name, p->>'$.versionInfo' AS version, p->>'$.licenseDeclared' AS lic, p->>'$.licenseConcluded' AS con,
  list_filter({_listed_sql("json_extract(p, '$.externalRefs')")}, lambda r: (r->>'$.referenceType') = 'purl')[1]->>'$.referenceLocator' AS purl FROM p),
i AS (SELECT *, coalesce(lower(purl), name || coalesce('@' || version, '')) AS id FROM q)
SELECT raw_id AS sbom_id, id, arg_max_null(name, pos) AS name, arg_max_null(version, pos) AS version, arg_max_null(coalesce(CASE WHEN lic NOT IN ('NOASSERTION', 'NONE', '') THEN lic END, CASE WHEN con NOT IN ('NOASSERTION', 'NONE', '') THEN con END), pos) AS licence FROM i WHERE id IS NOT NULL GROUP BY 1, 2"""
)
def src_spdx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of all SPDX documents, wrapped ones and only packages outside an array included."""
    return documents.spdx_json(documents.plain_json(_docs(spark, sf_dir))).components.select("sbom_id", "id", "name", "version", "licence")


@query(
    f"""WITH {_BARE}, v AS (SELECT raw_id, {_listed_sql("json_extract(d, '$.statements')")} AS ss FROM docs),
s AS (SELECT raw_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS seq FROM v),
n AS (SELECT raw_id, seq, s, unnest(list_distinct(list_filter(list_prepend(s->>'$.vulnerability.name', CASE WHEN json_type(s, '$.vulnerability.aliases') = 'ARRAY' THEN json_extract_string(s, '$.vulnerability.aliases[*]') WHEN json_type(s, '$.vulnerability.aliases') = 'VARCHAR' THEN [s->>'$.vulnerability.aliases'] ELSE [] END), lambda x: x IS NOT NULL))) AS vuln_id FROM s),
p AS (SELECT *, {_listed_sql("json_extract(s, '$.products')")} AS ps FROM n)
SELECT raw_id AS sbom_id, CAST(seq AS INTEGER) AS seq, vuln_id, CASE WHEN (s->>'$.status') IN ('not_affected', 'affected', 'fixed') THEN s->>'$.status' ELSE 'under_investigation' END AS status, CASE WHEN len(ps) > 0 THEN coalesce(p->>'$.identifiers.purl', p->>'$."@id"') END AS purl
FROM (SELECT *, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [NULL] END) AS p FROM p)"""
)
def src_openvex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all OpenVEX documents, wrapped ones and only statements outside an array included."""
    return documents.openvex(documents.plain_json(_docs(spark, sf_dir)))


_WRITTEN = """written AS (SELECT sbom_id || '/' || (part_no // 500) AS doc, coalesce(lower(purl), name || coalesce('@' || version, '')) AS id, name, version, supplier, licence, description, part_no FROM components)"""


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's components in texts of 500 at most."""
    c = testdata.components(spark, sf_dir)
    return c.withColumn("doc", F.concat_ws("/", F.col("sbom_id").cast("string"), F.floor(F.col("part_no") / 500).cast("string")))


def _texts(rows: DataFrame, line: F.Column, head: str = "", tail: str = "") -> DataFrame:
    parts = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part_no", line.alias("line")))).alias("lines"))
    return parts.select(F.col("doc").alias("sbom_id"), F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(tail)).alias("text"))


@query(f"{M}, {_WRITTEN} SELECT doc AS sbom_id, id, arg_max_null(name, part_no) AS name, arg_max_null(version, part_no) AS version, arg_max_null(supplier, part_no) AS supplier, arg_max_null(licence, part_no) AS licence FROM written GROUP BY 1, 2")
def src_spdx_tag_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components written as SPDX tag-value texts and read back."""
    field = lambda tag, c, lead="": F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{tag}: {lead}"), F.col(c)))
    line = F.concat_ws("\n", field("PackageName", "name"), field("SPDXID", "id", "SPDXRef-"), field("PackageVersion", "version"), field("PackageSupplier", "supplier", "Organization: "), field("PackageLicenseDeclared", "licence"), field("ExternalRef", "purl", "PACKAGE-MANAGER purl "))
    back = documents.spdx_tag_value(_texts(_written(spark, sf_dir), line, "SPDXVersion: SPDX-2.3\nDocumentName: fleet\n\n")).components
    return back.select("sbom_id", "id", "name", "version", "supplier", "licence")


@query(f"{M}, {_WRITTEN} SELECT doc AS sbom_id, id, arg_max_null(name, part_no) AS name, arg_max_null(version, part_no) AS version, arg_max_null(description, part_no) AS description FROM written GROUP BY 1, 2")
def src_cyclonedx_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components written as CycloneDX XML texts and read back."""
    tag = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), sinks.escape_html(F.col(c)), F.lit(f"</{c}>")))
    line = F.concat(F.lit('<component type="library">'), F.concat_ws("", *[tag(c) for c in ("name", "version", "description", "purl")]), F.lit("</component>"))
    texts = _texts(_written(spark, sf_dir), line, '<?xml version="1.0"?>\n<bom><components>\n', "\n</components></bom>")
    return documents.cyclonedx_xml(texts).select("sbom_id", "id", "name", "version", "description")


@query(f"{M}{PAIRS}{CHANGES} SELECT old_sbom, new_sbom, kind, id, name, coalesce(fields, '') AS fields, CAST(cost AS INTEGER) AS cost FROM changes")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component changes written as CSV and read back."""
    t = testdata.tables(spark, sf_dir)
    pairs = differ.consecutive_pairs(t)
    changes = differ.component_changes(t, pairs, differ.identity_matches(t, pairs))
    out = f"{shared_dir(spark)}/bomloom/csv-{uuid.uuid4().hex}"
    sinks.write_csv(out, components=changes)
    return spark.read.schema(changes.schema).option("header", True).csv(f"{out}/components").fillna("", ["fields"])


@query(f"""{M}{PAIRS}{CHANGES} SELECT old_sbom, new_sbom, count(*) AS changes, CAST(sum(cost) AS BIGINT) AS cost FROM changes GROUP BY 1, 2""")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports, read back."""
    t = testdata.tables(spark, sf_dir)
    pairs = differ.consecutive_pairs(t)
    changes = differ.component_changes(t, pairs, differ.identity_matches(t, pairs))
    reports = sinks.json_report(pairs.withColumn("title", F.lit("diff")), changes, ["old_sbom", "new_sbom"])
    rows = F.from_json("report", "components array<struct<kind: string, id: string, cost: int>>")["components"]
    return reports.select("old_sbom", "new_sbom", F.size(rows).cast("bigint").alias("changes"), F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, r: s + r["cost"]).alias("cost"))


@query(r"""WITH t AS (SELECT raw_id, t.fullkey AS path, t.type AS kind FROM nested_docs, json_tree(CASE WHEN json_valid(body) THEN body::JSON END) t)
SELECT raw_id, replace(path, '"', '') AS path, CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM t""")
def u_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nested_docs").select(F.col("raw_id").alias("doc_id"), "body")
    return documents.flattened(docs).select(F.col("doc_id").alias("raw_id"), F.replace("path", F.lit('"'), F.lit("")).alias("path"), "kind")


@query(f"{M} SELECT sbom_id, coalesce(lower(purl), name || coalesce('@' || version, '')) AS id, any_value(name) AS name, count(*) > 0 AS parsed FROM components GROUP BY 1, 2")
def src_cyclonedx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components written as CycloneDX documents and read back."""
    c = testdata.components(spark, sf_dir)
    item = F.struct(F.lit("library").alias("type"), F.col("id").alias("bom-ref"), "name", "version", "purl", "description")
    shards = c.withColumn("shard", F.col("part_no") % 16)  # one text must not hold a whole document of any size
    docs = shards.groupBy("sbom_id", "shard").agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.collect_list(item).alias("components"))).alias("text"))
    back = documents.cyclonedx_json(docs.select("sbom_id", "text")).components
    return back.groupBy("sbom_id", "id").agg(F.min("name").alias("name"), (F.count("*") > 0).alias("parsed"))


@query(f"{M}{PAIRS}{CHANGES} SELECT 'components' AS tag, count(*) AS n FROM changes UNION ALL SELECT 'vulns', count(*) FROM vulns")
def sink_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = testdata.tables(spark, sf_dir)
    pairs = differ.consecutive_pairs(t)
    rows = sinks.tagged_rows(components=differ.component_changes(t, pairs, differ.identity_matches(t, pairs)), vulns=t.vulns)
    return rows.groupBy(F.get_json_object("body", "$.tag").alias("tag")).agg(F.count("*").alias("n"))


@query(f"{M} SELECT sbom_id, count(*) AS results, count(DISTINCT vuln_id) AS rules, count(*) FILTER (severity IN ('critical', 'high')) AS errors FROM vulns GROUP BY 1")
def sink_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = testdata.tables(spark, sf_dir).vulns
    out = sinks.sarif(v.select("sbom_id", F.col("vuln_id").alias("rule_id"), "severity", F.col("component_id").alias("message")))
    run = F.from_json("sarif", "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<level: string>>>>")["runs"][0]
    return out.select("sbom_id", F.size(run["results"]).cast("bigint").alias("results"), F.size(run["tool"]["driver"]["rules"]).cast("bigint").alias("rules"), F.size(F.filter(run["results"], lambda r: r["level"] == "error")).cast("bigint").alias("errors"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def sink_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sinks.escape_html(F.col("text")).alias("html"))


@query("SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_dir(spark)}/bomloom/stream-{uuid.uuid4().hex}"
    counted = watch.run_to_table(watch.windowed_counts(events, "ts", "event_type"), f"{base}/out", f"{base}/checkpoint")
    return counted.withColumn("starts", F.col("starts").cast("timestamp_ntz"))


# --- data quality -----------------------------------------------------------------
@query(f"{M} SELECT sbom_id, count(*) AS components, " + ", ".join(f"round(100.0 * count({c}) / count(*), 6) AS with_{c}" for c in ("version", "purl", "supplier", "licence", "description", "hash")) + " FROM components GROUP BY 1")
def q_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(testdata.tables(spark, sf_dir))


@query(f"{M} SELECT sbom_id, count(*) FILTER (regexp_matches(purl, '^pkg:[a-z0-9.+-]+/.+')) AS valid_purls, count(*) FILTER (purl IS NULL) AS without, array_to_string(list_sort(list_distinct(list(ecosystem))), ',') AS ecosystems FROM components GROUP BY 1")
def q_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.identifiers(testdata.tables(spark, sf_dir))


@query(f"{M} SELECT sbom_id, CASE WHEN licence IN ('MIT', 'Apache-2.0') THEN 'permissive' WHEN licence = 'GPL-3.0-only' THEN 'strong_copyleft' ELSE 'unknown' END AS category, count(*) AS components, count(DISTINCT licence) AS licences FROM components GROUP BY 1, 2")
def q_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.licences(testdata.tables(spark, sf_dir))


@query(f"{M} SELECT sbom_id, count(*) AS vulns, count(cvss) AS scored, count(*) FILTER (severity <> 'none') AS rated, CAST(max(published) - min(published) AS INTEGER) AS span_days FROM vulns GROUP BY 1")
def q_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.documentation(testdata.tables(spark, sf_dir))
