"""Licence classification by substrings in a fixed order, and licence expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first row with a pattern that is found decides; patterns, category, risk, copyleft strength, family.
LADDER = [
    (["mit"], "permissive", "low", 0, "MIT"),
    (["apache"], "permissive", "low", 0, "Apache"),
    (["bsd"], "permissive", "low", 0, "BSD"),
    (["cc0"], "public_domain", "low", 0, "Creative Commons"),
    (["unlicense"], "public_domain", "low", 0, "Public Domain-like"),
    (["zlib"], "permissive", "low", 0, "Zlib"),
    (["isc", "wtfpl"], "permissive", "low", 0, "Public Domain-like"),
    (["agpl"], "network_copyleft", "critical", 4, "GPL"),
    (["lgpl"], "weak_copyleft", "medium", 1, "GPL"),
    (["gpl"], "strong_copyleft", "high", 3, "GPL"),
    (["mpl", "mozilla"], "weak_copyleft", "medium", 1, "MPL"),
    (["eclipse", "epl"], "weak_copyleft", "medium", 1, "Eclipse"),
    (["cddl"], "weak_copyleft", "medium", 1, "CDDL"),
    (["proprietary", "commercial", "private"], "proprietary", "critical", 0, "Proprietary"),
]
ADVERTISING = ["4-clause", "original"]
PATENT_FAMILIES = ["Apache", "MPL", "Eclipse", "CDDL"]
COMMON = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CDDL-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
]
DEPRECATED = [
    "AGPL-1.0", "AGPL-3.0", "BSD-2-Clause-FreeBSD", "BSD-2-Clause-NetBSD", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+", "LGPL-2.0", "LGPL-2.0+", "LGPL-2.1", "LGPL-2.1+",
    "LGPL-3.0", "LGPL-3.0+", "Nunit", "StandardML-NJ", "eCos-2.0", "wxWindows",
]
RESTRICTIVE = ["AGPL", "CC-BY-NC", "CC-BY-SA", "CPAL", "EUPL", "GPL", "LGPL", "OSL", "SSPL"]


def licence_info(text: Column) -> Column:
    """STRUCT<category, risk, strength, family, patent_grant, network>; unknown if no pattern is found or the text is null.

    BSD with an advertising clause is of medium risk; GPL licences grant patents from version 3 on.
    """
    low = F.coalesce(F.lower(text), F.lit(""))
    has = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    out = F.struct(F.lit("unknown").alias("category"), F.lit("medium").alias("risk"), F.lit(0).alias("strength"), F.lit("Unknown").alias("family"), F.lit(False).alias("patent_grant"), F.lit(False).alias("network"))
    for patterns, category, risk, strength, family in reversed(LADDER):
        level = F.when(has(ADVERTISING), "medium").otherwise(risk) if family == "BSD" else F.lit(risk)
        grant = low.contains("3") if family == "GPL" else F.lit(family in PATENT_FAMILIES)
        made = F.struct(F.lit(category).alias("category"), level.alias("risk"), F.lit(strength).alias("strength"), F.lit(family).alias("family"), grant.alias("patent_grant"), F.lit(category == "network_copyleft").alias("network"))
        out = F.when(has(patterns), made).otherwise(out)
    return out


def is_common(expression: Column) -> Column:
    """A widely used id, or an expression; null is not."""
    t = F.coalesce(F.trim(expression), F.lit(""))
    return t.isin(COMMON) | t.contains(" AND ") | t.contains(" OR ") | t.contains(" WITH ")


def is_deprecated(expression: Column) -> Column:
    return F.coalesce(F.trim(expression), F.lit("")).isin(DEPRECATED)


def is_restrictive(expression: Column) -> Column:
    t = F.upper(F.coalesce(F.trim(expression), F.lit("")))
    return F.greatest(*[t.startswith(p) for p in RESTRICTIVE])


def licence_family(expression: Column) -> Column:
    """permissive, weak_copyleft, copyleft or other of an expression of AND, OR and WITH.

    OR with a permissive option is permissive; otherwise the strictest part counts.
    """
    parts = F.transform(F.split(F.lower(expression), r"\s+(?:and|or)\s+|[()]"), lambda p: licence_info(F.trim(p))["category"])
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    free = has("permissive", "public_domain")
    return (
        F.when(F.lower(expression).contains(" or ") & free, "permissive")
        .when(has("strong_copyleft", "network_copyleft"), "copyleft").when(has("weak_copyleft"), "weak_copyleft").when(free, "permissive").otherwise("other")
    )


def compatibility(a: Column, b: Column) -> Column:
    """0 to 100 for two licences in one product; 0 is incompatible."""
    x, y, la, lb = licence_info(a), licence_info(b), F.lower(a), F.lower(b)
    either = lambda f: f(la, lb) | f(lb, la)
    closed = (x["category"] != y["category"]) & ((x["category"] == "proprietary") | (y["category"] == "proprietary"))
    versions = either(lambda p, q: p.contains("gpl-2.0-only") & q.contains("gpl-3"))
    patents = ((x["family"] == "Apache") & lb.contains("gpl-2")) | ((y["family"] == "Apache") & la.contains("gpl-2"))
    network = (x["category"] == "network_copyleft") | (y["category"] == "network_copyleft")
    gap = F.abs(x["strength"] - y["strength"])
    score = 100 - F.when(patents, 30).otherwise(0) - F.when(network, 20).otherwise(0) - F.when((x["category"] != y["category"]) & (gap > 1), gap * 10).otherwise(0)
    return F.when(closed | versions, 0).otherwise(F.greatest(score, F.lit(0))).cast("int")


def compatibility_report(licences: DataFrame, group: str = "sbom_id") -> DataFrame:
    """``group, licences, errors, warnings, score`` for the distinct licences (rows ``group, licence``) of each group.

    Two licences are an error if they are incompatible and a warning below 70;
    the score is 0 with an error and 15 less for every warning, 0 at least.
    Distinct licences are scored pair by pair once, whatever number of groups
    has them.
    """
    own = licences.where("licence is not null").select(group, "licence").distinct()
    met = own.withColumnRenamed("licence", "a").join(own.withColumnRenamed("licence", "b"), group).where("a < b")
    scored = met.select("a", "b").distinct().withColumn("pair_score", compatibility(F.col("a"), F.col("b")))
    bad = met.join(scored, ["a", "b"]).groupBy(group).agg(F.count_if(F.col("pair_score") == 0).alias("errors"), F.count_if((F.col("pair_score") > 0) & (F.col("pair_score") < 70)).alias("warnings"))
    full = own.groupBy(group).agg(F.count("*").alias("licences")).join(bad, group, "left").fillna(0, ["errors", "warnings"])
    return full.withColumn("score", F.when(F.col("errors") > 0, 0).otherwise(F.greatest(100 - 15 * F.col("warnings"), F.lit(0))).cast("int"))


class _Reader:
    """Recursive descent over the words of an expression: OR binds least, then AND, then WITH."""

    def __init__(self, text: str):
        self.words, self.at = text.replace("(", " ( ").replace(")", " ) ").split(), 0

    def peek(self) -> str:
        return self.words[self.at].upper() if self.at < len(self.words) else ""

    def take(self) -> str:
        self.at += 1
        return self.words[self.at - 1]

    def joined(self, word: str, below) -> dict:
        parts = [below()]
        while self.peek() == word:
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else {word.lower(): parts}

    def either(self) -> dict:
        return self.joined("OR", lambda: self.joined("AND", self.term))

    def term(self) -> dict:
        if self.peek() in ("", ")", "OR", "AND", "WITH"):
            raise ValueError(self.peek())
        if self.peek() == "(":
            self.take()
            inner = self.either()
            if self.peek() != ")":
                raise ValueError("open bracket")
            self.take()
            return inner
        own = {"licence": self.take()}
        if self.peek() == "WITH":
            self.take()
            if self.peek() in ("", "(", ")", "OR", "AND", "WITH"):
                raise ValueError("no exception")
            own["with"] = self.take()
        return own


def parse_expression(text: str | None) -> str | None:
    """An expression's tree as JSON; null where it is none (NOASSERTION and NONE included)."""
    if text is None or not text.strip() or "NOASSERTION" in text or "NONE" in text:
        return None
    reader = _Reader(text)
    try:
        tree = reader.either()
    except (ValueError, RecursionError):
        return None
    return json.dumps(tree) if reader.at == len(reader.words) else None


def expression_tree(expression: Column) -> Column:
    """``parse_expression`` of a column; call it on distinct values."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(parse_expression)

    return run(expression)
