"""The relational model: one row per document, component, edge or vulnerability, keyed by ``sbom_id``.

One document and a thousand run as the same plan: every operator takes these
tables and keeps ``sbom_id`` (or a pair of them) in its result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENT_COLUMNS = ("sbom_id", "id", "name", "version", "ecosystem", "supplier", "licence", "purl", "description", "hash")
EDGE_COLUMNS = ("sbom_id", "from_id", "to_id", "relationship", "scope")
VULN_COLUMNS = ("sbom_id", "component_id", "vuln_id", "cvss", "severity", "published")

# Severities in their order.
SEVERITIES = ["unknown", "none", "info", "low", "medium", "high", "critical"]


@dataclass(frozen=True)
class Tables:
    components: DataFrame
    edges: DataFrame
    vulns: DataFrame


def severity_rank(severity: Column) -> Column:
    """0 unknown to 6 critical; anything else, null included, is unknown."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    return F.coalesce(ranks[F.lower(severity)], F.lit(0))


def severity_of(cvss: Column) -> Column:
    """The severity band of a CVSS base score."""
    return (
        F.when(cvss.isNull(), "unknown").when(cvss >= 9.0, "critical").when(cvss >= 7.0, "high").when(cvss >= 4.0, "medium").when(cvss >= 0.1, "low").otherwise("none")
    )


def content_hash() -> Column:
    """Whether a component changed in anything but its id (null is a value)."""
    fields = ("name", "version", "purl", "licence", "supplier", "hash")
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in fields])
