"""Data quality of documents: how complete, how well identified, how well licensed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.functions.licence import licence_info
from bomloom.model import Tables


def completeness(t: Tables) -> DataFrame:
    """Percent of a document's components with each field."""
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 6).alias(f"with_{c}")
    return t.components.groupBy("sbom_id").agg(F.count("*").alias("components"), *[share(c) for c in ("version", "purl", "supplier", "licence", "description", "hash")])


def identifiers(t: Tables) -> DataFrame:
    """Valid package URLs, components without any identifier, and the ecosystems of each document."""
    valid = F.coalesce(F.col("purl").rlike(r"^pkg:[a-z0-9.+-]+/.+"), F.lit(False))
    return t.components.groupBy("sbom_id").agg(F.count_if(valid).alias("valid_purls"), F.count_if(F.col("purl").isNull()).alias("without"), F.array_join(F.array_sort(F.collect_set("ecosystem")), ",").alias("ecosystems"))


def licences(t: Tables) -> DataFrame:
    """Licensed components by category."""
    return t.components.groupBy("sbom_id", licence_info(F.col("licence"))["category"].alias("category")).agg(F.count("*").alias("components"), F.count_distinct("licence").alias("licences"))


def documentation(t: Tables) -> DataFrame:
    """How many vulnerabilities carry a score and a severity, and how old they are at most before the newest."""
    return t.vulns.groupBy("sbom_id").agg(F.count("*").alias("vulns"), F.count("cvss").alias("scored"), F.count_if(F.col("severity") != "none").alias("rated"), F.datediff(F.max("published"), F.min("published")).alias("span_days"))
