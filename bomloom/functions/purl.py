"""Package URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def purl_type(purl: Column) -> Column:
    kind = F.regexp_extract(purl, r"^pkg:([^/]+)", 1)
    return F.when(kind != "", kind)


def purl_name(purl: Column) -> Column:
    name = F.regexp_extract(purl, r"^pkg:[^/]+/(?:.*/)?([^/@?#]*)[^/]*$", 1)
    return F.when(name != "", name)


def purl_version(purl: Column) -> Column:
    return F.when(purl.contains("@"), F.regexp_extract(purl, r"@([^?#]*)", 1))


def purl_normal(purl: Column) -> Column:
    """The spelling a package type compares by; types with case-sensitive names keep theirs."""
    kind, low = F.lower(purl_type(purl)), F.lower(purl)
    return (
        F.when(kind == "pypi", F.regexp_replace(low, "[_.]", "-"))
        .when(kind == "npm", F.replace(low, F.lit("%40"), F.lit("@")))
        .when(kind == "cargo", F.replace(low, F.lit("-"), F.lit("_")))
        .when(kind.isin("maven", "golang"), purl)
        .otherwise(low)
    )


def purl_base(purl: Column) -> Column:
    """Lower case, without the part from the last @ on."""
    return F.regexp_replace(F.lower(purl), "@[^@]*$", "")


def name_normal(name: Column, ecosystem: Column) -> Column:
    """The spelling a package name is indexed by in its ecosystem."""
    low = F.lower(name)
    return (
        F.when(ecosystem == "pypi", F.regexp_replace(low, "[_.]+", "-"))
        .when(ecosystem == "cargo", F.replace(low, F.lit("-"), F.lit("_")))
        .when(ecosystem == "npm", low)
        .otherwise(F.regexp_replace(F.replace(low, F.lit("_"), F.lit("-")), "-+", "-"))
    )
