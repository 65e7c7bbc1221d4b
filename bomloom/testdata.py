"""The star-schema test tables seen as a fleet of software bills of materials.

Every order year is a document; the parts ordered in it are its components.
``MODEL_SQL`` builds the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.model import Tables, severity_of
from bomloom.runtime import materialize, table

LICENCES = {"A": "MIT", "N": "Apache-2.0", "R": "GPL-3.0-only"}
ECOSYSTEMS = {"economy": "npm", "small": "pypi", "medium": "maven", "promo": "cargo", "standard": "golang", "large": "nuget"}


def _lookup(pairs: dict[str, str], key) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("sbom_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    grouped = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("sbom_id", "l_partkey")
        .agg(F.max("l_linenumber").alias("top"), F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    k, eco = F.col("p_partkey"), _lookup(ECOSYSTEMS, F.lower("p_type"))
    version = F.when(k % 11 != 0, F.concat_ws(".", F.col("top").cast("string"), (F.col("n") % 3).cast("string"), (F.col("n") % 2).cast("string")))
    return grouped.select(
        "sbom_id", k.alias("part_no"), F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), version.alias("version"), eco.alias("ecosystem"),
        F.when(k % 7 != 0, F.col("p_brand")).alias("supplier"), F.when(F.col("p_size") % 7 != 0, _lookup(LICENCES, F.col("flag"))).alias("licence"),
        F.when(k % 5 != 0, F.concat(F.lit("pkg:"), eco, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.coalesce(F.concat(F.lit("@"), version), F.lit("")))).alias("purl"),
        F.when(k % 3 != 0, F.concat(F.lit("The "), F.col("p_name"))).alias("description"), F.when(k % 4 != 0, F.concat(F.lit("h"), k.cast("string"), F.lit("-"), F.col("n").cast("string"))).alias("hash"),
    )


def edges(comps: DataFrame) -> DataFrame:
    k = F.col("part_no")
    third, half = F.floor(k / 3), F.floor(k / 2)
    one = lambda keep, a, b: F.when(keep, F.struct(a.alias("a"), b.alias("b")))
    made = F.array(one(k >= 1, k, third), one((k % 4 == 1) & (k >= 2), k, half), one((k % 50 == 7) & (k >= 3), third, k), one(k % 97 == 0, k, k))
    pairs = comps.select("sbom_id", "part_no", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("sbom_id", "part_no", "e.a", "e.b").distinct()
    here = comps.select("sbom_id", F.col("part_no").alias("p"))
    both = pairs.join(here.withColumnRenamed("p", "a"), ["sbom_id", "a"], "left_semi").join(here.withColumnRenamed("p", "b"), ["sbom_id", "b"], "left_semi")
    kind = F.when((F.col("a") + F.col("sbom_id")) % 6 == 0, "optional-depends-on").when(F.col("a") % 2 == 0, "depends-on").otherwise("dev-depends-on")
    name = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    return both.select("sbom_id", name("a").alias("from_id"), name("b").alias("to_id"), kind.alias("relationship"), F.when(F.col("b") % 5 == 0, "optional").when(F.col("b") % 5 < 4, "required").alias("scope")).distinct()


def vulns(spark: SparkSession, sf_dir: str, comps: DataFrame) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    cvss = F.round(F.least(F.col("value") / 10, F.lit(10.0)), 1)
    found = errors.join(F.broadcast(n)).select(
        (F.col("event_id") % F.col("n_parts")).alias("part_no"), F.col("event_id"), F.concat(F.lit("CVE-2024-"), F.lpad(F.get_json_object("props", "$.k"), 4, "0")).alias("vuln_id"), cvss.alias("cvss"), F.to_date("ts").alias("published")
    )
    both = found.join(comps.select("sbom_id", "part_no", F.col("id").alias("component_id")), "part_no").where((F.col("event_id") + F.col("sbom_id")) % 3 != 0)
    return both.groupBy("sbom_id", "component_id", "vuln_id").agg(F.max("cvss").alias("cvss"), F.min("published").alias("published")).withColumn("severity", severity_of(F.col("cvss")))


def tables(spark: SparkSession, sf_dir: str, cut: bool = False) -> Tables:
    """The three tables; ``cut`` writes them once for operators that loop over them."""
    comps = components(spark, sf_dir)
    if cut:
        comps = materialize(comps, "components")
    made, found = edges(comps), vulns(spark, sf_dir, comps)
    return Tables(comps, *[materialize(x, n) if cut else x for x, n in ((made, "edges"), (found, "vulns"))])


MODEL_SQL = """
components AS (
  SELECT sbom_id, part_no, id, name, version, ecosystem, supplier, licence,
    CASE WHEN part_no % 5 <> 0 THEN 'pkg:' || ecosystem || '/' || replace(name, ' ', '-') || coalesce('@' || version, '') END AS purl,
    CASE WHEN part_no % 3 <> 0 THEN 'The ' || name END AS description, CASE WHEN part_no % 4 <> 0 THEN 'h' || part_no || '-' || n END AS hash
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS sbom_id, p_partkey AS part_no, 'part:' || p_partkey AS id, p_name AS name, count(*) AS n,
    CASE WHEN p_partkey % 11 <> 0 THEN max(l_linenumber) || '.' || (count(*) % 3) || '.' || (count(*) % 2) END AS version,
    CASE lower(p_type) WHEN 'economy' THEN 'npm' WHEN 'small' THEN 'pypi' WHEN 'medium' THEN 'maven' WHEN 'promo' THEN 'cargo' WHEN 'standard' THEN 'golang' WHEN 'large' THEN 'nuget' END AS ecosystem,
    CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS supplier,
    CASE WHEN p_size % 7 <> 0 THEN CASE min(l_returnflag) WHEN 'A' THEN 'MIT' WHEN 'N' THEN 'Apache-2.0' WHEN 'R' THEN 'GPL-3.0-only' END END AS licence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY year(o_orderdate), p_partkey, p_name, p_brand, p_type, p_size)),
raw_edges AS (
  SELECT sbom_id, part_no AS a, part_no // 3 AS b FROM components WHERE part_no >= 1
  UNION SELECT sbom_id, part_no, part_no // 2 FROM components WHERE part_no % 4 = 1 AND part_no >= 2
  UNION SELECT sbom_id, part_no // 3, part_no FROM components WHERE part_no % 50 = 7 AND part_no >= 3
  UNION SELECT sbom_id, part_no, part_no FROM components WHERE part_no % 97 = 0),
edges AS (
  SELECT DISTINCT sbom_id, 'part:' || a AS from_id, 'part:' || b AS to_id,
    CASE WHEN (a + sbom_id) % 6 = 0 THEN 'optional-depends-on' WHEN a % 2 = 0 THEN 'depends-on' ELSE 'dev-depends-on' END AS relationship,
    CASE WHEN b % 5 = 0 THEN 'optional' WHEN b % 5 < 4 THEN 'required' END AS scope
  FROM raw_edges r WHERE EXISTS (SELECT 1 FROM components c WHERE c.sbom_id = r.sbom_id AND c.part_no = r.a) AND EXISTS (SELECT 1 FROM components c WHERE c.sbom_id = r.sbom_id AND c.part_no = r.b)),
vulns AS (
  SELECT *, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss >= 0.1 THEN 'low' ELSE 'none' END AS severity
  FROM (SELECT c.sbom_id, c.id AS component_id, 'CVE-2024-' || lpad(json_extract_string(props, '$.k'), 4, '0') AS vuln_id, max(round(least(value / 10, 10.0), 1)) AS cvss, min(CAST(ts AS DATE)) AS published
    FROM events JOIN components c ON c.part_no = event_id % (SELECT count(*) FROM part) WHERE event_type = 'error' AND (event_id + c.sbom_id) % 3 <> 0 GROUP BY 1, 2, 3))"""
