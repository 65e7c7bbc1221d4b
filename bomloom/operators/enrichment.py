"""Joins to advisory, exploit, lifecycle and VEX tables; dates are counted from ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days to fix by severity, days of a lifecycle warning, and ages.
SLA_DAYS = {"critical": 1, "high": 7, "medium": 30, "low": 90}
EOL_WARNING_DAYS = 180
AGES = {"abandoned": 730, "stale": 365, "aging": 182}


def with_kev(vulns: DataFrame, kev: DataFrame, as_of: Column) -> DataFrame:
    """Known exploited vulnerabilities (``cve_id, due_date``) joined by id; days until due and overdue flag."""
    catalogue = kev.select(F.upper(F.trim("cve_id")).alias("kev_id"), "due_date").dropDuplicates(["kev_id"])
    out = vulns.join(catalogue, F.upper(F.trim("vuln_id")) == F.col("kev_id"), "left")
    left = F.datediff("due_date", as_of)
    return out.withColumn("is_kev", F.col("kev_id").isNotNull()).withColumn("days_until_due", left).withColumn("overdue", F.coalesce(left < 0, F.lit(False))).drop("kev_id")


def sla_status(days_until_due: Column, severity: Column, published: Column, as_of: Column) -> Column:
    """overdue, due_soon, on_track or no_due_date: a given due date first, else the severity's days from publication."""
    days = F.create_map(*[F.lit(x) for kv in SLA_DAYS.items() for x in kv])[F.lower(severity)]
    left = F.coalesce(days_until_due, days - F.datediff(as_of, published))
    return F.when(left.isNull(), "no_due_date").when(left < 0, "overdue").when(left <= 3, "due_soon").otherwise("on_track")


def with_lifecycle(components: DataFrame, cycles: DataFrame, as_of: Column) -> DataFrame:
    """The lifecycle (``product, cycle, eol DATE, support DATE``) of each component's version.

    A version meets its cycle exactly, else by major.minor, else by major.
    """
    bits = F.split("version", r"\.")
    keys = F.array_distinct(F.filter(F.array(F.col("version"), F.concat_ws(".", bits[0], F.get(bits, F.lit(1))), bits[0]), lambda k: k.isNotNull()))
    tries = components.select("sbom_id", "id", F.lower("name").alias("product"), F.posexplode(keys).alias("place", "cycle"))
    met = tries.join(cycles.withColumn("product", F.lower("product")), ["product", "cycle"]).groupBy("sbom_id", "id").agg(F.min_by(F.struct("cycle", "eol", "support"), "place").alias("m"))
    left = F.datediff("m.eol", as_of)
    status = F.when(left <= 0, "end_of_life").when(left.between(0, EOL_WARNING_DAYS), "approaching").when(F.col("m.support") <= as_of, "security_only").when(F.col("m").isNotNull(), "supported").otherwise("unknown")
    return components.select("sbom_id", "id").join(met, ["sbom_id", "id"], "left").select("sbom_id", "id", F.col("m.cycle").alias("cycle"), left.alias("days_until_eol"), status.alias("status"))


def staleness(archived: Column, deprecated: Column, last_published: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, last_published)
    return F.when(archived, "archived").when(deprecated, "deprecated").when(age >= AGES["abandoned"], "abandoned").when(age >= AGES["stale"], "stale").when(age >= AGES["aging"], "aging").otherwise("fresh")


def with_vex(vulns: DataFrame, components: DataFrame, statements: DataFrame) -> DataFrame:
    """VEX status by (vulnerability, purl), else by vulnerability alone; later statements (``seq``) override."""
    last = lambda d, keys: d.groupBy(*keys).agg(F.max_by("status", "seq").alias("status"))
    exact = last(statements.where("purl is not null"), ["vuln_id", "purl"]).withColumnRenamed("status", "exact")
    wide = last(statements.where("purl is null"), ["vuln_id"]).withColumnRenamed("status", "wide")
    named = vulns.join(components.select("sbom_id", F.col("id").alias("component_id"), "purl"), ["sbom_id", "component_id"], "left")
    return named.join(exact, ["vuln_id", "purl"], "left").join(wide, "vuln_id", "left").withColumn("vex_status", F.coalesce("exact", "wide")).drop("exact", "wide")


def actionable(vulns_with_vex: DataFrame) -> DataFrame:
    """Vulnerabilities that no statement rules out."""
    return vulns_with_vex.where(F.coalesce("vex_status", F.lit("")).isin("not_affected", "fixed") == F.lit(False))


def advisory_rows(advisories: DataFrame, body: str) -> DataFrame:
    """OSV-like JSON to rows: id, summary, first numeric score, fixed versions, affected versions."""
    schema = "id string, summary string, details string, severity array<struct<type: string, score: string>>, affected array<struct<ranges: array<struct<events: array<map<string,string>>>>, versions: array<string>>>, published string"
    j = advisories.select(F.from_json(body, schema).alias("o")).where("o.id is not null").select("o.*")
    scores = F.filter(F.transform(F.coalesce("severity", F.array()), lambda s: s["score"].try_cast("double")), lambda x: x.isNotNull())
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull())
    return j.select(F.col("id").alias("vuln_id"), F.coalesce("summary", "details").alias("summary"), F.get(scores, F.lit(0)).alias("cvss"), F.coalesce(fixed, F.array()).alias("fixed"), F.flatten(F.transform("affected", lambda a: F.coalesce(a["versions"], F.array()))).alias("versions"))


def with_advisories(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """``sbom_id, id, vuln_id, cvss``: advisories by package URL, else by name, ecosystem and version.

    ``advisories``: ``vuln_id, purl, name, ecosystem, version, cvss``; a row with a
    purl is met by it alone.  Of repeated rows the highest score stands.
    """
    by_purl = advisories.where("purl is not null").groupBy(F.lower("purl").alias("p"), "vuln_id").agg(F.max("cvss").alias("cvss"))
    met = components.select("sbom_id", "id", F.lower("purl").alias("p")).join(by_purl, "p").drop("p")
    named = advisories.where("purl is null").groupBy(F.lower("name").alias("n"), F.lower("ecosystem").alias("e"), F.col("version").alias("v"), "vuln_id").agg(F.max("cvss").alias("cvss"))
    known = by_purl.select("p").distinct()
    rest = components.select("sbom_id", "id", F.lower("purl").alias("p"), F.lower("name").alias("n"), F.lower("ecosystem").alias("e"), F.col("version").alias("v")).join(known, "p", "left_anti")
    return met.unionByName(rest.join(named, ["n", "e", "v"]).select("sbom_id", "id", "vuln_id", "cvss")).select("sbom_id", "id", "vuln_id", "cvss")
