"""Dependency graphs of many documents at once: fixpoints by frontier joins.

Every round is a written table in the shared folder, so lineage stays short and
a lost executor costs one round.  All loops end when no row is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.model import Tables
from bomloom.runtime import materialize

CYCLIC = 2**31 - 1


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("sbom_id", "from_id", "to_id").distinct()


def roots(t: Tables) -> DataFrame:
    """Components without incoming edges."""
    return t.components.select("sbom_id", "id").join(t.edges.select("sbom_id", F.col("to_id").alias("id")).distinct(), ["sbom_id", "id"], "left_anti")


def depths(t: Tables, root_depth: int = 1, max_depth: int = 0, sentinel: int | None = CYCLIC, sources: DataFrame | None = None) -> DataFrame:
    """``sbom_id, id, depth``: shortest distance from the roots (or ``sources``).

    Components that no root reaches get ``sentinel``, or no row if it is None;
    ``max_depth`` 0 means no bound.
    """
    arcs = materialize(_arcs(t.edges), "arcs")
    frontier = materialize((sources if sources is not None else roots(t)).select("sbom_id", "id").distinct().withColumn("depth", F.lit(root_depth)), "depth-0")
    seen, level = frontier, root_depth
    while not frontier.isEmpty() and not (max_depth and level >= max_depth):
        level += 1
        step = frontier.join(arcs, (frontier.sbom_id == arcs.sbom_id) & (frontier.id == arcs.from_id)).select(arcs.sbom_id, F.col("to_id").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["sbom_id", "id"], "left_anti").withColumn("depth", F.lit(level)), f"depth-{level}")
        seen = seen.unionByName(frontier)
    if sentinel is None:
        return seen
    return t.components.select("sbom_id", "id").join(seen, ["sbom_id", "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(sentinel)))


def closure(t: Tables) -> DataFrame:
    """``sbom_id, id, reached``: all components that an id reaches by one edge or more."""
    arcs = materialize(_arcs(t.edges), "arcs")
    delta = arcs.select("sbom_id", F.col("from_id").alias("id"), F.col("to_id").alias("reached"))
    known = materialize(delta, "closure-0")
    delta, n = known, 0
    while not delta.isEmpty():
        n += 1
        step = delta.join(arcs.withColumnRenamed("from_id", "reached"), ["sbom_id", "reached"]).select("sbom_id", "id", F.col("to_id").alias("reached")).distinct()
        delta = materialize(step.join(known, ["sbom_id", "id", "reached"], "left_anti"), f"closure-{n}")
        known = known.unionByName(delta)
    return known


def blast_radius(t: Tables, reach: DataFrame | None = None) -> DataFrame:
    """Direct and transitive dependents of every component, and the risk level they make.

    A component on a cycle is its own dependent.
    """
    reach = closure(t) if reach is None else reach
    transitive = reach.groupBy("sbom_id", F.col("reached").alias("id")).agg(F.count("*").alias("transitive"))
    direct = _arcs(t.edges).groupBy("sbom_id", F.col("to_id").alias("id")).agg(F.count("*").alias("direct"))
    vulnerable = t.vulns.select("sbom_id", F.col("component_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    full = t.components.select("sbom_id", "id").join(direct, ["sbom_id", "id"], "left").join(transitive, ["sbom_id", "id"], "left").join(vulnerable, ["sbom_id", "id"], "left").fillna(0, ["direct", "transitive"])
    hit, n = F.coalesce("hit", F.lit(False)), F.col("transitive")
    level = F.when(hit & (n > 10), "critical").when(hit | (n > 20), "high").when(n > 5, "medium").otherwise("low")
    return full.select("sbom_id", "id", "direct", "transitive", level.alias("risk_level"))


def islands(t: Tables) -> DataFrame:
    """``sbom_id, id, island``: weakly connected components, named by their smallest id.

    Labels of the neighbours and of the own label's label are taken over
    (pointer jumping), so long chains need few rounds.
    """
    arcs = _arcs(t.edges)
    both = materialize(arcs.select("sbom_id", F.col("from_id").alias("id"), F.col("to_id").alias("near")).unionByName(arcs.select("sbom_id", F.col("to_id").alias("id"), F.col("from_id").alias("near"))).distinct(), "near")
    labels = materialize(t.components.select("sbom_id", "id", F.col("id").alias("island")), "islands-0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.withColumnRenamed("id", "near"), ["sbom_id", "near"]).groupBy("sbom_id", "id").agg(F.min("island").alias("offer"))
        closer = labels.join(near, ["sbom_id", "id"], "left").select("sbom_id", "id", F.least("island", F.coalesce("offer", "island")).alias("island"), F.col("island").alias("before"))
        jump = closer.select("sbom_id", F.col("id").alias("island"), F.col("island").alias("further"))
        new = closer.join(jump, ["sbom_id", "island"], "left").select("sbom_id", "id", F.least("island", F.coalesce("further", "island")).alias("island"), "before")
        new = materialize(new, f"islands-{n}")
        labels = new.drop("before")
        if new.where("island <> before").isEmpty():
            return labels


def degrees(t: Tables) -> DataFrame:
    """Edges, roots, orphans, leaves and the largest fan-out of each document (parallel edges count)."""
    out = t.edges.groupBy("sbom_id", F.col("from_id").alias("id")).agg(F.count("*").alias("fan_out"))
    into = t.edges.groupBy("sbom_id", F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"))
    full = t.components.select("sbom_id", "id").join(out, ["sbom_id", "id"], "left").join(into, ["sbom_id", "id"], "left").fillna(0, ["fan_out", "fan_in"])
    o, i = F.col("fan_out") > 0, F.col("fan_in") > 0
    return full.groupBy("sbom_id").agg(F.sum("fan_out").alias("edges"), F.count_if(o & ~i).alias("roots"), F.count_if(~o & i).alias("leaves"), F.count_if(~o & ~i).alias("orphans"), F.max("fan_out").alias("max_fan_out"))


def cyclic_nodes(t: Tables) -> DataFrame:
    """Components that reach themselves.

    Components without incoming or without outgoing edges are on no cycle and are
    peeled off round by round.  What is left are cycles and the ways between
    them; only there is it followed what reaches what.
    """
    arcs, n = materialize(_arcs(t.edges), "core-0"), 0
    while True:
        n += 1
        heads = arcs.select("sbom_id", F.col("from_id").alias("id")).distinct()
        both = heads.join(arcs.select("sbom_id", F.col("to_id").alias("id")).distinct(), ["sbom_id", "id"])
        inner = arcs.join(both.withColumnRenamed("id", "from_id"), ["sbom_id", "from_id"], "left_semi").join(both.withColumnRenamed("id", "to_id"), ["sbom_id", "to_id"], "left_semi")
        inner = materialize(inner, f"core-{n}")
        if inner.count() == arcs.count():
            break
        arcs = inner
    reach = closure(Tables(t.components, arcs, t.vulns))
    return reach.where("id = reached").select("sbom_id", "id")


def complexity(t: Tables, found_islands: DataFrame, found_depths: DataFrame, cyclic: DataFrame) -> DataFrame:
    """A document's simplicity from volume, depth, fan-out, cycles and fragmentation (0 complex, 100 simple)."""
    d = degrees(t)
    n = t.components.groupBy("sbom_id").agg(F.count("*").alias("n"))
    parts = found_islands.groupBy("sbom_id").agg(F.count_distinct("island").alias("islands"))
    depth = found_depths.where(F.col("depth") < CYCLIC).groupBy("sbom_id").agg(F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"))
    cycles = cyclic.groupBy("sbom_id").agg(F.count("*").alias("cyclic"))
    f = d.join(n, "sbom_id").join(parts, "sbom_id").join(depth, "sbom_id", "left").join(cycles, "sbom_id", "left").fillna(0, ["cyclic", "max_depth"])
    clamp = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    volume = clamp(F.ln(1.0 + F.col("edges") / F.greatest(F.col("n"), F.lit(1))) / F.ln(F.lit(20.0)))
    deep, fan = clamp(F.col("max_depth") / 15.0), clamp((F.col("max_fan_out") - 1) / 99.0)
    loops, split = clamp(F.col("cyclic") / F.greatest(F.lit(1.0), F.col("n") * 0.05)), clamp((F.col("islands") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    score = 100.0 * (1.0 - (0.30 * volume + 0.20 * deep + 0.20 * fan + 0.20 * loops + 0.10 * split))
    return f.select("sbom_id", "edges", "roots", "islands", "max_depth", "cyclic", F.round(score, 6).alias("simplicity"))


def _paired(frame: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    return frame.join(pairs.withColumn("sbom_id", F.col(which)), "sbom_id").drop("sbom_id")


def dependency_diff(t: Tables, pairs: DataFrame, matches: DataFrame, found_depths: DataFrame) -> DataFrame:
    """Changes of each matched component's dependencies, with their impact.

    ``kind`` is dependency_added, dependency_removed, relationship_changed,
    depth_changed or reparented; ``other_id`` the dependency, ``detail`` the old
    and new relationship, depth or parent.  Old children without a match don't
    count.  A component with lost and new parents is reparented from the smallest
    to the smallest; that pair's added and removed rows are dropped.
    """
    p = ["old_sbom", "new_sbom"]
    arcs = t.edges.groupBy("sbom_id", "from_id", "to_id").agg(F.max(F.concat_ws("/", "relationship", F.coalesce("scope", F.lit("")))).alias("attr"))
    old, new = _paired(arcs, pairs, "old_sbom"), _paired(arcs, pairs, "new_sbom")
    m = matches.select(*p, "old_id", "new_id")
    mapped = old.join(m.withColumnsRenamed({"old_id": "from_id", "new_id": "parent"}), [*p, "from_id"]).join(m.withColumnsRenamed({"old_id": "to_id", "new_id": "child"}), [*p, "to_id"]).select(*p, "parent", "child", F.col("attr").alias("old_attr"))
    current = new.join(m.select(*p, F.col("new_id").alias("from_id")), [*p, "from_id"]).select(*p, F.col("from_id").alias("parent"), F.col("to_id").alias("child"), F.col("attr").alias("new_attr"))
    both = mapped.join(current, [*p, "parent", "child"], "full_outer")
    rank = found_depths.select(F.col("sbom_id").alias("new_sbom"), F.col("id").alias("child"), "depth")
    hit = t.vulns.select(F.col("sbom_id").alias("new_sbom"), F.col("component_id").alias("child")).distinct().withColumn("hit", F.lit(True))
    both = both.join(rank, ["new_sbom", "child"], "left").join(hit, ["new_sbom", "child"], "left")
    direct = F.coalesce((F.col("depth") > 0) & (F.col("depth") <= 2), F.lit(False))
    impact = F.when(F.col("hit") & direct, "critical").when(F.col("hit"), "high").when(direct, "medium").otherwise("low")
    kind = F.when(F.col("old_attr").isNull(), "dependency_added").when(F.col("new_attr").isNull(), "dependency_removed").when(F.col("old_attr") != F.col("new_attr"), "relationship_changed")
    level = F.when(kind == "dependency_added", impact).when(kind == "relationship_changed", "medium").otherwise("low")
    detail = F.when(kind == "relationship_changed", F.concat_ws(" -> ", "old_attr", "new_attr")).otherwise("")
    edges = both.select(*p, F.col("parent").alias("id"), kind.alias("kind"), F.col("child").alias("other_id"), detail.alias("detail"), level.alias("impact")).where("kind is not null")
    lost = edges.where("kind = 'dependency_removed'").groupBy(*p, F.col("other_id").alias("child")).agg(F.min("id").alias("was"))
    got = new.join(mapped.select(*p, F.col("parent").alias("from_id"), F.col("child").alias("to_id")), [*p, "from_id", "to_id"], "left_anti").join(m.select(*p, F.col("new_id").alias("to_id")), [*p, "to_id"], "left_semi").groupBy(*p, F.col("to_id").alias("child")).agg(F.min("from_id").alias("now"))
    moved = lost.join(got, [*p, "child"])
    parent_row = lambda k, c: moved.select(*p, F.col(c).alias("id"), F.col("child").alias("other_id"), F.lit(k).alias("kind"))
    kept = edges.join(parent_row("dependency_added", "now").unionByName(parent_row("dependency_removed", "was")), [*p, "id", "other_id", "kind"], "left_anti")
    reparented = moved.select(*p, F.col("child").alias("id"), F.lit("reparented").alias("kind"), F.col("child").alias("other_id"), F.concat_ws(" -> ", "was", "now").alias("detail"), F.lit("medium").alias("impact"))
    return kept.select(reparented.columns).unionByName(reparented).unionByName(depth_changes(t, matches, found_depths).select(reparented.columns))


def depth_changes(t: Tables, matches: DataFrame, found_depths: DataFrame) -> DataFrame:
    """Matched components whose depth differs; two unreachable ends are no change."""
    old = found_depths.select(F.col("sbom_id").alias("old_sbom"), F.col("id").alias("old_id"), F.col("depth").alias("od"))
    new = found_depths.select(F.col("sbom_id").alias("new_sbom"), F.col("id").alias("new_id"), F.col("depth").alias("nd"))
    hit = t.vulns.select(F.col("sbom_id").alias("new_sbom"), F.col("component_id").alias("new_id")).distinct().withColumn("hit", F.lit(True))
    d = matches.join(old, ["old_sbom", "old_id"]).join(new, ["new_sbom", "new_id"]).where("od <> nd").join(hit, ["new_sbom", "new_id"], "left")
    level = F.when((F.col("nd") < F.col("od")) & F.col("hit"), "high").when((F.col("nd") <= 2) & (F.col("od") > 2), "medium").otherwise("low")
    show = lambda c: F.when(F.col(c) == CYCLIC, "unreachable").otherwise(F.col(c).cast("string"))
    return d.select("old_sbom", "new_sbom", F.col("new_id").alias("id"), F.lit("depth_changed").alias("kind"), F.col("new_id").alias("other_id"), F.concat_ws(" -> ", show("od"), show("nd")).alias("detail"), level.alias("impact"))


def impact_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("old_sbom", "new_sbom", "kind", "impact").agg(F.count("*").alias("n"))


def attack_paths(t: Tables, max_depth: int = 5) -> DataFrame:
    """Shortest ways from roots to vulnerable components: length and the smallest way as text."""
    arcs = materialize(_arcs(t.edges), "arcs")
    paths = materialize(roots(t).join(t.edges.select("sbom_id", F.col("from_id").alias("id")).distinct(), ["sbom_id", "id"], "left_semi").select("sbom_id", F.col("id").alias("root"), "id", F.col("id").alias("way"), F.lit(0).alias("hops")), "paths-0")
    seen = frontier = paths
    for hop in range(1, max_depth + 1):
        step = frontier.join(arcs.withColumnRenamed("from_id", "id"), ["sbom_id", "id"]).groupBy("sbom_id", "root", F.col("to_id").alias("id")).agg(F.min(F.concat_ws(">", "way", "to_id")).alias("way"))
        frontier = materialize(step.join(seen, ["sbom_id", "root", "id"], "left_anti").withColumn("hops", F.lit(hop)), f"paths-{hop}")
        seen = seen.unionByName(frontier)
    targets = t.vulns.groupBy("sbom_id", F.col("component_id").alias("id")).agg(F.max("cvss").alias("max_cvss"))
    risk = F.when(F.col("hops") <= 1, 100).when(F.col("hops") == 2, 90).when(F.col("hops") == 3, 70).when(F.col("hops") == 4, 50).otherwise(30)
    return seen.where("hops > 0").join(targets, ["sbom_id", "id"]).select("sbom_id", "root", "id", "hops", "way", risk.alias("risk"))


def adjacency(t: Tables, ids: list[str]) -> DataFrame:
    """Edges that touch the chosen ids, told apart as their dependencies and their dependents."""
    out = t.edges.where(F.col("from_id").isin(ids)).withColumn("role", F.lit("dependency"))
    return out.unionByName(t.edges.where(F.col("to_id").isin(ids)).withColumn("role", F.lit("dependent")))


IMPACTS = ["low", "medium", "high", "critical"]


def at_least(changes: DataFrame, impact: str) -> DataFrame:
    """Changes of an impact or a higher one."""
    return changes.where(F.col("impact").isin(IMPACTS[IMPACTS.index(impact) :]))


def related(edges: DataFrame, relationships: list[str]) -> DataFrame:
    """Edges of the given relationships, whatever their letter case."""
    return edges.where(F.lower("relationship").isin([r.lower() for r in relationships]))
