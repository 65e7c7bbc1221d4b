"""Versions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def semver(text: Column) -> Column:
    """STRUCT<major, minor, patch BIGINT, pre STRING> of a strict three-part version, else null."""
    part = lambda i: F.regexp_extract(text, _STRICT, i)
    whole = F.struct(*[part(i + 1).try_cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))], part(4).alias("pre"))
    return F.when(text.rlike(_STRICT), whole)


def lenient_parts(text: Column) -> Column:
    """STRUCT<major, minor, patch BIGINT>: a leading v is dropped, what doesn't parse behind the major counts 0."""
    bits = F.split(F.regexp_replace(text, "^[vV]+", ""), r"[.+-]")
    number = lambda i: F.get(bits, F.lit(i)).try_cast("bigint")
    parsed = F.struct(number(0).alias("major"), F.coalesce(number(1), F.lit(0)).alias("minor"), F.coalesce(number(2), F.lit(0)).alias("patch"))
    return F.when(F.get(bits, F.lit(0)).rlike(r"^\d+$"), parsed)


def boost_parts(version: Column) -> Column:
    """STRUCT<major, minor INT> as ``version_boost`` compares them."""
    bits = F.split(version, r"\.")
    return F.struct(F.get(bits, F.lit(0)).try_cast("int").alias("major"), F.split(F.get(bits, F.lit(1)), "-")[0].try_cast("int").alias("minor"))


def version_boost(a: Column, b: Column, parts: tuple[Column, Column] | None = None) -> Column:
    """0.10 equal, 0.07 same major and minor, 0.04 same major, else 0 (null included); ``parts`` if they are known."""
    pa, pb = parts or (boost_parts(a), boost_parts(b))
    (ma, na), (mb, nb) = ((p["major"], p["minor"]) for p in (pa, pb))
    return F.coalesce(F.when(a == b, 0.10).when((ma == mb) & (na == nb), 0.07).when(ma == mb, 0.04), F.lit(0.0))


def version_divergence(a: Column, b: Column, minor_penalty: float = 0.02, major_penalty: float = 0.10, parts: tuple[Column, Column] | None = None, parsed: bool = False) -> Column:
    """Graduated closeness of two versions: 1 equal, 0.5 both missing, 0 one missing.

    ``parts`` (``lenient_parts``) if they are known; ``parsed`` if every version has them.
    """
    pa, pb = parts or (lenient_parts(a), lenient_parts(b))
    gap = lambda f: F.abs(pa[f] - pb[f])
    by_parts = (
        F.when((pa["major"] == pb["major"]) & (pa["minor"] == pb["minor"]), F.greatest(0.8 - 0.01 * gap("patch"), F.lit(0.5)))
        .when(pa["major"] == pb["major"], F.greatest(0.5 - minor_penalty * gap("minor"), F.lit(0.2)))
        .otherwise(F.greatest(0.3 - major_penalty * gap("major"), F.lit(0.0)))
    )
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))) - 1
    by_prefix = F.when(same > 0, F.least(same / F.greatest(F.octet_length(a), F.octet_length(b)) * 0.5, F.lit(0.4))).otherwise(0.1)
    both = F.when(a == b, 1.0).otherwise(by_parts if parsed else F.when(pa.isNotNull() & pb.isNotNull(), by_parts).otherwise(by_prefix))
    return F.when(a.isNull() & b.isNull(), 0.5).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def change_class(previous: Column, current: Column) -> Column:
    """major, minor, patch or downgrade between two versions that differ; text order if either isn't semver."""
    p, c = semver(previous), semver(current)
    core = lambda s: F.struct(s["major"], s["minor"], s["patch"])
    by_parts = F.when(core(c) <= core(p), "downgrade").when(c["major"] > p["major"], "major_upgrade").when(c["minor"] > p["minor"], "minor_upgrade").otherwise("patch_upgrade")
    by_text = F.when(current > previous, "patch_upgrade").otherwise("downgrade")
    return F.when(p.isNotNull() & c.isNotNull(), by_parts).otherwise(by_text)


def number_parts(text: Column) -> Column:
    """ARRAY<BIGINT>: the numbers of the first dotted run of digits; empty if there is none."""
    run = F.filter(F.split(F.regexp_extract(text, r"[0-9][0-9.]*", 0), r"\."), lambda x: x != "")
    return F.transform(run, lambda x: x.try_cast("bigint"))


def direction(was: Column, now: Column) -> Column:
    """upgrade, downgrade or none, number by number (more numbers are newer); by text if a side has no number."""
    a, b = number_parts(was), number_parts(now)
    by_text = F.when(now == was, "none").when(now < was, "downgrade").otherwise("upgrade")
    by_number = F.when(now == was, "none").when(b > a, "upgrade").when(b < a, "downgrade").otherwise("none")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), by_number).otherwise(by_text)


def downgrade_severity(was: Column, now: Column) -> Column:
    """major if the first number falls, suspicious if a word for a repair goes, else minor; null if it is no downgrade of numbers."""
    a, b = number_parts(was), number_parts(now)
    repaired = lambda c: F.lower(c).rlike("security|patch|fix")
    level = F.when(F.get(b, F.lit(0)) < F.get(a, F.lit(0)), "major").when(repaired(was) & ~repaired(now), "suspicious").otherwise("minor")
    return F.when((direction(was, now) == "downgrade") & (F.size(a) > 0) & (F.size(b) > 0), level)


def matches_requirement(version: Column, requirement: str) -> Column:
    """Whether a version meets a list of comparators (``>=1.2, <2``, ``~1.4``, ``^0.3``, ``1.*``).

    Both must be semver, else the texts are compared without letter case.  A
    pre-release only matches a requirement that names a pre-release of the same
    three numbers.  A null version matches nothing.
    """
    s = semver(version)
    core = F.struct(s["major"], s["minor"], s["patch"])
    clauses, named = [], []
    for raw in requirement.split(","):
        m = re.fullmatch(r"\s*(<=|>=|<|>|=|~|\^)?\s*[vV]?(\d+)(?:\.(\d+|\*|x))?(?:\.(\d+|\*|x))?(?:-([0-9A-Za-z.-]+))?\s*", raw)
        if not m:
            return F.coalesce(F.lower(version) == requirement.lower(), F.lit(False))
        op, pre = m[1] or "^", m[5]
        nums = [int(m[2])] + [int(x) for x in (m[3], m[4]) if x and x.isdigit()]
        if m[1] is None and ("*" in raw or "x" in raw.lower()):
            op = "="
        at = lambda n: F.struct(*[F.lit(x).cast("bigint") for x in (n + [0, 0])[:3]])
        low, size = at(nums), len(nums)
        up = lambda keep: at([*nums[: keep - 1], nums[keep - 1] + 1])  # noqa: E731, B023
        if pre:
            named.append((core == low) & (s["pre"] != ""))
        if op == "=":
            clauses.append((core >= low) & (core < up(size)) if size < 3 else (core == low) & (s["pre"] == (pre or "")))
        elif op == ">":
            clauses.append(core >= up(size) if size < 3 else (core > low) | ((core == low) & (s["pre"] > pre if pre else F.lit(False))))
        elif op == ">=":
            clauses.append((core > low) | ((core == low) & (((s["pre"] >= pre) | (s["pre"] == "")) if pre else F.lit(True))))
        elif op == "<":
            clauses.append((core < low) | ((core == low) & (((s["pre"] < pre) & (s["pre"] != "")) if pre else F.lit(False))))
        elif op == "<=":
            clauses.append(core < up(size) if size < 3 else (core < low) | ((core == low) & (((s["pre"] <= pre) & (s["pre"] != "")) if pre else F.lit(True))))
        elif op == "~":
            clauses.append((core >= low) & (core < up(min(size, 2))))
        else:
            first = next((i for i, x in enumerate(nums) if x), size - 1)
            clauses.append((core >= low) & (core < up(first + 1)))
    ok = s.isNotNull()
    for c in clauses:
        ok = ok & c
    release = s["pre"] == ""
    for n in named:
        release = release | n
    return F.coalesce(ok & release, F.lit(False))
