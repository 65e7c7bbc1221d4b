"""Semantic diff of many document pairs in one plan, keyed by (old_sbom, new_sbom)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.version import semver
from bomloom.model import Tables, content_hash, severity_rank
from bomloom.operators.matching import PRESETS, Preset, alike, alike_scores, assign
from bomloom.runtime import ranked

# What a change costs.
COSTS = {"added": 10, "removed": 10, "patch": 2, "minor": 4, "major": 7, "licence": 6, "supplier": 4, "introduced": 15, "resolved": -3, "edge_added": 5, "edge_removed": 5, "hash": 8}
PAIR = ["old_sbom", "new_sbom"]


def consecutive_pairs(t: Tables) -> DataFrame:
    """Each document with the next one by id; only the ids of documents are ordered."""
    ids = ranked(t.components.select("sbom_id").distinct(), "sbom_id", "place")
    after = ids.select(F.col("sbom_id").alias("new_sbom"), (F.col("place") - 1).alias("place"))
    return ids.withColumnRenamed("sbom_id", "old_sbom").join(after, "place").select("old_sbom", "new_sbom")


def baseline_pairs(t: Tables, baseline: int) -> DataFrame:
    """One document against every other."""
    others = t.components.where(F.col("sbom_id") != baseline).select(F.col("sbom_id").alias("new_sbom")).distinct()
    return others.select(F.lit(baseline).cast(dict(t.components.dtypes)["sbom_id"]).alias("old_sbom"), "new_sbom")


def cumulative_pairs(t: Tables) -> DataFrame:
    """The first document against every later one."""
    first = t.components.agg(F.min("sbom_id").alias("old_sbom"))
    return t.components.select(F.col("sbom_id").alias("new_sbom")).distinct().join(first, F.col("new_sbom") > F.col("old_sbom")).select("old_sbom", "new_sbom")


def _side(frame: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """Rows of one side of every pair."""
    return frame.join(pairs.withColumn("sbom_id", F.col(which)), "sbom_id").drop("sbom_id")


def identity_matches(t: Tables, pairs: DataFrame) -> DataFrame:
    """``old_sbom, new_sbom, old_id, new_id, score``: components with one id match exactly."""
    old = _side(t.components.select("sbom_id", "id"), pairs, "old_sbom")
    new = _side(t.components.select("sbom_id", "id"), pairs, "new_sbom")
    return old.join(new, [*PAIR, "id"]).select(*PAIR, F.col("id").alias("old_id"), F.col("id").alias("new_id"), F.lit(1.0).alias("score"))


def unmatched(t: Tables, pairs: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of both sides of every pair that no match holds, by ``old_sbom, new_sbom``."""
    old = _side(t.components, pairs, "old_sbom").join(matches.select(*PAIR, F.col("old_id").alias("id")), [*PAIR, "id"], "left_anti")
    return old, _side(t.components, pairs, "new_sbom").join(matches.select(*PAIR, F.col("new_id").alias("id")), [*PAIR, "id"], "left_anti")


def without_twins(t: Tables, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unmatched`` of ``identity_matches``, in one join a side: the components whose id the other document lacks."""
    ids = lambda other: t.components.select(F.col("sbom_id").alias(other), "id")
    old = _side(t.components, pairs, "old_sbom").join(ids("new_sbom"), ["new_sbom", "id"], "left_anti")
    new = _side(t.components, pairs, "new_sbom").join(ids("old_sbom"), ["old_sbom", "id"], "left_anti")
    return tuple(d.select(*PAIR, *[c for c in t.components.columns if c != "sbom_id"]) for d in (old, new))


def full_matches(t: Tables, pairs: DataFrame, preset: Preset = PRESETS["balanced"]) -> DataFrame:
    """Identity matches, and the best assignment of what they leave by tiered scores: one to one in every pair."""
    same = identity_matches(t, pairs)
    sides = tuple(alike(d, tuple(PAIR)) for d in unmatched(t, pairs, same))
    scored = alike_scores(*sides, by=tuple(PAIR), preset=preset)
    return same.unionByName(assign(scored, None, tuple(PAIR), sides))


def component_changes(t: Tables, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Added, removed and modified components with the changed fields and their cost.

    Modified means: the content differs and a field change is found.  Sets of
    licences count as fields, a hash only if the version is the same and both
    sides have one.  Null is a value of version, licence and supplier.
    """
    fields = ["id", "name", "version", "licence", "supplier", "hash"]
    base = t.components.select("sbom_id", *fields, content_hash().alias("content"))
    old, new = _side(base, pairs, "old_sbom"), _side(base, pairs, "new_sbom")
    rename = lambda d, p: d.select(*PAIR, *[F.col(c).alias(f"{p}_{c}") for c in (*fields, "content")])
    old, new = rename(old, "old"), rename(new, "new")
    removed = old.join(matches, [*PAIR, "old_id"], "left_anti").select(*PAIR, F.lit("removed").alias("kind"), F.col("old_id").alias("id"), F.col("old_name").alias("name"), F.lit("").alias("fields"), F.lit(COSTS["removed"]).alias("cost"))
    added = new.join(matches, [*PAIR, "new_id"], "left_anti").select(*PAIR, F.lit("added").alias("kind"), F.col("new_id").alias("id"), F.col("new_name").alias("name"), F.lit("").alias("fields"), F.lit(COSTS["added"]).alias("cost"))
    both = matches.join(old, [*PAIR, "old_id"]).join(new, [*PAIR, "new_id"]).where("old_content <> new_content")
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    o, n = semver(F.col("old_version")), semver(F.col("new_version"))
    step = F.when(o.isNotNull() & n.isNotNull(), F.when(o["major"] != n["major"], COSTS["major"]).when(o["minor"] != n["minor"], COSTS["minor"]).when(o["patch"] != n["patch"], COSTS["patch"]).otherwise(0)).when(o.isNull() & n.isNull(), 0).otherwise(COSTS["minor"])
    hash_change = ~differs("version") & F.coalesce(F.col("old_hash") != F.col("new_hash"), F.lit(False))
    checks: list[tuple[str, Column, Column]] = [("version", differs("version"), step), ("licences", differs("licence"), F.lit(COSTS["licence"])), ("supplier", differs("supplier"), F.lit(COSTS["supplier"])), ("hashes", hash_change, F.lit(COSTS["hash"]))]
    changed = F.array_join(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c, _ in checks]), lambda x: x.isNotNull()), ",")
    cost = sum((F.when(c, k).otherwise(0) for _, c, k in checks), F.lit(0))
    modified = both.select(*PAIR, F.lit("modified").alias("kind"), F.col("new_id").alias("id"), F.col("new_name").alias("name"), changed.alias("fields"), cost.cast("int").alias("cost")).where("fields <> ''")
    return removed.unionByName(added).unionByName(modified)


def edge_changes(t: Tables, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Dependencies added and removed after old ends are mapped through the matches (unmatched ends stay)."""
    old, new = _side(t.edges, pairs, "old_sbom"), _side(t.edges, pairs, "new_sbom")
    for end in ("from_id", "to_id"):
        mapped = matches.select(*PAIR, F.col("old_id").alias(end), F.col("new_id").alias("mapped"))
        old = old.join(mapped, [*PAIR, end], "left").withColumn(end, F.coalesce("mapped", end)).drop("mapped")
    key = [*PAIR, "from_id", "to_id", "relationship"]
    same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in key] + [F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope"))]
    added = new.alias("n").join(old.alias("o"), same("n", "o"), "left_anti").select(*key, "scope", F.lit("added").alias("kind"))
    removed = old.alias("o").join(new.alias("n"), same("o", "n"), "left_anti").select(*key, "scope", F.lit("removed").alias("kind"))
    return added.unionByName(removed)


def licence_changes(t: Tables, pairs: DataFrame) -> DataFrame:
    """Licences that only one side of a pair has, with the number of its components."""
    per = t.components.where("licence is not null").groupBy("sbom_id", "licence").agg(F.count("*").alias("n_components"))
    old, new = _side(per, pairs, "old_sbom"), _side(per, pairs, "new_sbom")
    fresh = new.join(old, [*PAIR, "licence"], "left_anti").withColumn("kind", F.lit("new"))
    return fresh.unionByName(old.join(new, [*PAIR, "licence"], "left_anti").withColumn("kind", F.lit("removed")))


def vulnerability_changes(t: Tables, pairs: DataFrame) -> DataFrame:
    """Introduced, resolved and persistent vulnerabilities; an id on both sides persists whatever component has it."""
    rows = t.vulns.select("sbom_id", "vuln_id", "component_id", "severity").distinct()
    old, new = _side(rows, pairs, "old_sbom"), _side(rows, pairs, "new_sbom")
    key = [*PAIR, "vuln_id"]
    tag = lambda d, k: d.select(*key, "component_id", "severity", F.lit(k).alias("kind"))
    return tag(new.join(old, key, "left_anti"), "introduced").unionByName(tag(old.join(new, key, "left_anti"), "resolved")).unionByName(tag(new.join(old, key, "left_semi"), "persistent"))


def summary(components: DataFrame, edges: DataFrame, vulns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of every kind of change and the summed cost of all changes of each pair (0: nothing changed)."""
    none = F.lit(0).alias("cost")
    tagged = (
        components.select(*PAIR, F.concat(F.lit("components_"), "kind").alias("what"), "cost")
        .unionByName(edges.select(*PAIR, F.concat(F.lit("edges_"), "kind").alias("what"), none))
        .unionByName(vulns.select(*PAIR, F.concat(F.lit("vulns_"), "kind").alias("what"), none))
    )
    kinds = ["components_added", "components_removed", "components_modified", "edges_added", "edges_removed", "vulns_introduced", "vulns_resolved", "vulns_persistent"]
    counts = tagged.groupBy(*PAIR).agg(*[F.count_if(F.col("what") == k).alias(k) for k in kinds], F.sum("cost").alias("component_cost"))
    full = pairs.join(counts, PAIR, "left").fillna(0, [*kinds, "component_cost"])
    c = F.col
    score = c("component_cost") + c("edges_added") * COSTS["edge_added"] + c("edges_removed") * COSTS["edge_removed"] + c("vulns_introduced") * COSTS["introduced"] + c("vulns_resolved") * COSTS["resolved"]
    total = c("components_added") + c("components_removed") + c("components_modified") + c("edges_added") + c("edges_removed")
    return full.withColumn("total_changes", total).withColumn("score", score.cast("double")).drop("component_cost")


def deviations(summary: DataFrame) -> DataFrame:
    """How far each document is from the baseline (100 less the score), and the largest such value, 0 at least."""
    far = summary.select(*PAIR, (100.0 - F.col("score")).alias("deviation"))
    return far.withColumn("max_deviation", F.greatest(F.max("deviation").over(Window.partitionBy("old_sbom")), F.lit(0.0)))


def introduced_severities(vulns: DataFrame) -> DataFrame:
    """Introduced vulnerabilities of each pair by severity."""
    return vulns.where("kind = 'introduced'").groupBy(*PAIR, "severity").agg(F.count("*").alias("n"))


def vulnerability_groups(vulns: DataFrame) -> DataFrame:
    """Vulnerabilities of each component: number, worst severity and score."""
    rank = severity_rank(F.col("severity"))
    return vulns.groupBy("sbom_id", "component_id").agg(F.count("*").alias("n_vulns"), F.max_by("severity", rank).alias("worst"), F.max("cvss").alias("max_cvss"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "high").alias("n_high"))


def severity_counts(t: Tables) -> DataFrame:
    known = ["critical", "high", "medium", "low"]
    return t.vulns.groupBy("sbom_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in known], F.count_if(~F.col("severity").isin(known)).alias("unknown"))


def section_hashes(t: Tables) -> DataFrame:
    """One order-free hash for each section of a document: equal sections need no diff.

    Row hashes are summed, so a document's rows are never held together; the sums
    of two independent hashes and the number of rows make the section's hash.
    """
    def section(d: DataFrame, cols: list[str], name: str) -> DataFrame:
        row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
        sums = [F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
        return d.groupBy("sbom_id").agg(F.concat_ws("/", F.count("*").cast("string"), *sums).alias(name))

    comps = t.components.select("sbom_id", "id", content_hash().alias("content"))
    return (
        section(comps, ["id", "content"], "components_hash").join(section(t.edges, ["from_id", "to_id", "relationship", "scope"], "edges_hash"), "sbom_id", "full_outer")
        .join(section(t.components, ["id", "licence"], "licences_hash"), "sbom_id", "full_outer").join(section(t.vulns, ["component_id", "vuln_id"], "vulns_hash"), "sbom_id", "full_outer")
    )


def section_flags(t: Tables, pairs: DataFrame) -> DataFrame:
    """Which sections differ in each pair."""
    h = section_hashes(t)
    names = [c for c in h.columns if c != "sbom_id"]
    old = _side(h, pairs, "old_sbom").select(*PAIR, *[F.col(n).alias(f"o_{n}") for n in names])
    new = _side(h, pairs, "new_sbom").select(*PAIR, *[F.col(n).alias(f"n_{n}") for n in names])
    return old.join(new, PAIR).select(*PAIR, *[(~F.col(f"o_{n}").eqNullSafe(F.col(f"n_{n}"))).alias(n.replace("_hash", "_changed")) for n in names])
