"""Fleet search: filters over components, merged hits, side lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.version import matches_requirement
from bomloom.model import Tables, severity_rank


@dataclass(frozen=True)
class Query:
    """Filters that must all hold; texts are compared without letter case."""

    pattern: str | None = None
    name: str | None = None
    purl: str | None = None
    version: str | None = None
    licence: str | None = None
    ecosystem: str | None = None
    supplier: str | None = None
    affected_by: str | None = None

    def condition(self) -> Column:
        has = lambda column, text: F.coalesce(F.contains(F.lower(F.col(column)), F.lit(text.lower())), F.lit(False))
        parts: list[Column] = []
        if self.pattern is not None:
            parts.append(reduce(lambda a, b: a | b, [has(c, self.pattern) for c in ("name", "version", "purl", "id")]))
        for column, text in (("name", self.name), ("purl", self.purl), ("licence", self.licence), ("supplier", self.supplier)):
            if text is not None:
                parts.append(has(column, text))
        if self.ecosystem is not None:
            parts.append(F.coalesce(F.lower("ecosystem") == self.ecosystem.lower(), F.lit(False)))
        if self.version is not None:
            ranged = self.version[:1] in "<>=~^" or "," in self.version
            parts.append(matches_requirement(F.col("version"), self.version) if ranged else F.coalesce(F.lower("version") == self.version.lower(), F.lit(False)))
        if not parts and self.affected_by is None:
            raise ValueError("a query needs at least one filter")
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def describe(self) -> str:
        given = [(k, v) for k, v in vars(self).items() if v is not None]
        return " AND ".join(f"{k.replace('_', ' ')} '{v}'" for k, v in given)


def hits(t: Tables, query: Query) -> DataFrame:
    """The components that meet every filter; null fields meet none."""
    found = t.components.where(query.condition())
    if query.affected_by is not None:
        ids = t.vulns.where(F.upper("vuln_id") == query.affected_by.upper()).select("sbom_id", F.col("component_id").alias("id")).distinct()
        found = found.join(ids, ["sbom_id", "id"], "left_semi")
    return found


def merged_hits(t: Tables, query: Query, limit: int | None = None) -> DataFrame:
    """Hits of one name and version as one row, with where they were found and their vulnerabilities.

    Names agree without letter case, a missing version is ''; ``ecosystem`` and
    ``licence`` come from the first document that has a hit.  Sorted by name and
    version; ``limit`` is a top-k report.
    """
    found = hits(t, query).select("sbom_id", "id", "name", F.coalesce("version", F.lit("")).alias("version"), "ecosystem", "licence")
    key = [F.lower("name").alias("name_key"), F.col("version")]
    ids = t.vulns.select("sbom_id", F.col("component_id").alias("id"), "vuln_id").join(found, ["sbom_id", "id"]).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("vuln_id")), ",").alias("vuln_ids"))
    first = lambda c: F.min_by(c, F.struct("sbom_id", "id")).alias(c)
    groups = found.groupBy(*key).agg(first("name"), first("ecosystem"), first("licence"), F.array_join(F.transform(F.array_sort(F.collect_set("sbom_id")), lambda s: s.cast("string")), ",").alias("found_in"), F.count("*").alias("hits"))
    out = groups.join(ids, ["name_key", "version"], "left").withColumn("vuln_ids", F.coalesce("vuln_ids", F.lit("")))
    return out.orderBy("name_key", "version").limit(limit) if limit is not None else out


def query_summary(t: Tables, query: Query) -> DataFrame:
    """Components and hits of each document."""
    n = hits(t, query).groupBy("sbom_id").agg(F.count("*").alias("n_hits"))
    return t.components.groupBy("sbom_id").agg(F.count("*").alias("n_components")).join(n, "sbom_id", "left").fillna(0, ["n_hits"])


def view(t: Tables, vulnerable_only: bool = False, min_severity: str | None = None, ecosystem: str | None = None) -> DataFrame:
    """Components of a view: one without vulnerabilities passes ``min_severity`` unless ``vulnerable_only``."""
    worst = t.vulns.groupBy("sbom_id", F.col("component_id").alias("id")).agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    out = t.components.join(worst, ["sbom_id", "id"], "left")
    if vulnerable_only:
        out = out.where("worst is not null")
    if min_severity is not None:
        out = out.where(F.col("worst").isNull() | (F.col("worst") >= severity_rank(F.lit(min_severity))))
    return out.where(F.contains(F.lower("ecosystem"), F.lit(ecosystem.lower()))) if ecosystem is not None else out


def search_everything(t: Tables, text: str, limit: int = 50) -> DataFrame:
    """Name, else purl, then vulnerability ids that hold the text: the first ``limit`` in that order, of two letters at least."""
    low = F.lit(text.lower())
    field = F.when(F.contains(F.lower("name"), low), F.struct(F.lit(0).alias("rank"), F.lit("name").alias("match_field"))).when(F.contains(F.lower("purl"), low), F.struct(F.lit(1).alias("rank"), F.lit("purl").alias("match_field")))
    comps = t.components.withColumn("f", field).where("f is not null").select("f.rank", "f.match_field", "sbom_id", "id", F.col("name").alias("label"))
    ids = t.vulns.where(F.contains(F.lower("vuln_id"), low)).select(F.lit(2).alias("rank"), F.lit("vulnerability").alias("match_field"), "sbom_id", F.col("component_id").alias("id"), F.col("vuln_id").alias("label"))
    return comps.unionByName(ids).where(F.lit(len(text) >= 2)).orderBy("rank", "label", "sbom_id", "id").limit(limit)


def vulnerability_list(t: Tables, min_severity: str | None = None) -> DataFrame:
    """One row for each document and vulnerability id: affected components, worst score, first component's severity."""
    rows = t.vulns if min_severity is None else t.vulns.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    named = rows.join(t.components.select("sbom_id", F.col("id").alias("component_id"), "name"), ["sbom_id", "component_id"])
    return named.groupBy("sbom_id", "vuln_id").agg(
        F.count("*").alias("affected"), F.max("cvss").alias("max_cvss"), F.min_by("severity", "component_id").alias("severity"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")
    )


def grouped_tree(t: Tables, by: str) -> DataFrame:
    """Components and vulnerabilities by a column, most components first."""
    n = t.vulns.groupBy("sbom_id", F.col("component_id").alias("id")).agg(F.count("*").alias("v"))
    label = F.coalesce(F.col(by), F.lit("Unknown")).alias("label")
    return t.components.join(n, ["sbom_id", "id"], "left").groupBy("sbom_id", label).agg(F.count("*").alias("items"), F.coalesce(F.sum("v"), F.lit(0)).alias("vulns")).orderBy("sbom_id", F.desc("items"), "label")


def severity_tree(t: Tables) -> DataFrame:
    """Components by their worst severity."""
    worst = t.vulns.groupBy("sbom_id", F.col("component_id").alias("id")).agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("bucket"))
    return t.components.join(worst, ["sbom_id", "id"], "left").groupBy("sbom_id", F.coalesce("bucket", F.lit("clean")).alias("bucket")).agg(F.count("*").alias("items"))


def urgency(t: Tables, blast: DataFrame) -> DataFrame:
    """Rank of a vulnerable component: severity, score and reach of its dependents, 100 at most."""
    reach = F.coalesce("transitive", F.lit(0))
    bucket = F.when(reach > 50, 20).when(reach > 20, 15).when(reach > 10, 10).when(reach > 0, 5).otherwise(0)
    joined = t.vulns.join(blast.select("sbom_id", F.col("id").alias("component_id"), "transitive"), ["sbom_id", "component_id"], "left")
    score = F.least(severity_rank(F.col("severity")) * 10 + F.floor(F.coalesce("cvss", F.lit(0.0)) * 3) + bucket, F.lit(100))
    w = Window.partitionBy("sbom_id", "component_id").orderBy(F.desc("urgency"), "vuln_id")
    return joined.select("sbom_id", "component_id", "vuln_id", score.cast("int").alias("urgency")).withColumn("rank_in_component", F.row_number().over(w))
