"""Many documents compared: presence, versions, timelines, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.version import change_class, semver
from bomloom.model import Tables
from bomloom.operators.set_join import similar_sets
from bomloom.runtime import materialize, ranked


def _documents(t: Tables) -> DataFrame:
    return t.components.select("sbom_id").distinct()


def universal(t: Tables) -> DataFrame:
    """Ids that every document has."""
    n = _documents(t).agg(F.count("*").alias("n_documents"))
    per = t.components.groupBy("id").agg(F.count_distinct("sbom_id").alias("present"))
    return per.join(F.broadcast(n), F.col("present") == F.col("n_documents")).select("id", "present")


def variable(t: Tables) -> DataFrame:
    """Ids with more than one version (a missing one is ''), with the spread by text and by number."""
    v = t.components.select("id", "name", F.coalesce("version", F.lit("")).alias("version"))
    major = F.coalesce(semver(F.col("version"))["major"], F.regexp_extract("version", r"^(\d+)(?:[._-]|$)", 1).try_cast("bigint"))
    g = v.groupBy("id").agg(F.count_distinct("version").alias("n_versions"), F.min("version").alias("min_version"), F.max("version").alias("max_version"), F.coalesce(F.max(major) - F.min(major), F.lit(0)).alias("major_spread"), F.min("name").alias("name"))
    return g.where("n_versions > 1")


def inconsistent(t: Tables) -> DataFrame:
    """Ids that some documents lack: how many have them and how many don't."""
    n = _documents(t).agg(F.count("*").alias("n"))
    per = t.components.groupBy("id").agg(F.count_distinct("sbom_id").alias("present_in"))
    return per.join(F.broadcast(n), F.col("present_in") < F.col("n")).select("id", "present_in", (F.col("n") - F.col("present_in")).alias("missing_from"))


def divergent(t: Tables, baseline: int) -> DataFrame:
    """Each other document against the baseline: added, removed and other versions.

    A component whose baseline version is missing counts as added.
    """
    base = t.components.where(F.col("sbom_id") == baseline).select("id", F.col("version").alias("baseline_version"), F.lit(True).alias("in_base"))
    others = t.components.where(F.col("sbom_id") != baseline).select("sbom_id", "id", F.coalesce("version", F.lit("")).alias("target_version"))
    kind = F.when(F.col("baseline_version").isNull(), "added").when(F.col("baseline_version") != F.col("target_version"), "version_mismatch")
    here = others.join(base, "id", "left").withColumn("kind", kind).where("kind is not null")
    grid = others.select("sbom_id").distinct().join(base)  # every other document against the one baseline
    gone = grid.join(others.select("sbom_id", "id"), ["sbom_id", "id"], "left_anti")
    columns = ["sbom_id", "id", "kind", "baseline_version", "target_version"]
    return here.select(columns).unionByName(gone.select("sbom_id", "id", F.lit("removed").alias("kind"), "baseline_version", F.lit("").alias("target_version")))


def vulnerability_matrix(t: Tables) -> DataFrame:
    """Each vulnerability id: in how many documents, whether in all or in one alone."""
    n = _documents(t).agg(F.count("*").alias("n"))
    per = t.vulns.groupBy("vuln_id").agg(F.count_distinct("sbom_id").alias("documents"), F.min("sbom_id").alias("first_in"))
    scope = F.when(F.col("documents") == F.col("n"), "common").when(F.col("documents") == 1, "unique").otherwise("shared")
    return per.join(F.broadcast(n)).select("vuln_id", "documents", scope.alias("scope"), F.when(F.col("documents") == 1, F.col("first_in")).alias("only_in"))


def history(t: Tables) -> DataFrame:
    """The class of change of each id in each document that has it, against the last one before, and where it goes.

    initial, unchanged, major/minor/patch upgrade or downgrade, and removed in the
    document after one that has the id; a missing version is ''.  Documents that
    go on lacking an id have no row, so the result grows with the components.
    """
    docs = ranked(_documents(t), "sbom_id", "snapshot")
    w = Window.partitionBy("id").orderBy("snapshot")
    here = t.components.select("sbom_id", "id", F.coalesce("version", F.lit("")).alias("version")).join(docs, "sbom_id")
    here = here.withColumn("previous", F.lag("version").over(w)).withColumn("next", F.lead("snapshot").over(w))
    kind = F.when(F.col("previous").isNull(), "initial").when(F.col("version") == F.col("previous"), "unchanged").otherwise(change_class(F.col("previous"), F.col("version")))
    own = here.select("sbom_id", "id", "version", kind.alias("change"))
    gone = here.where("next is null or next > snapshot + 1").select("id", (F.col("snapshot") + 1).alias("snapshot")).join(docs, "snapshot")
    return own.unionByName(gone.select("sbom_id", "id", F.lit(None).cast("string").alias("version"), F.lit("removed").alias("change")))


def evolution(t: Tables) -> DataFrame:
    """First and last document of each id, whether it is still there, and how often its version changed."""
    last = _documents(t).agg(F.max("sbom_id").alias("newest"), F.min("sbom_id").alias("oldest"))
    seen = t.components.groupBy("id").agg(F.min("sbom_id").alias("first_seen"), F.max("sbom_id").alias("last_seen"))
    changes = history(t).groupBy("id").agg(F.count_if(F.col("change").isin("major_upgrade", "minor_upgrade", "patch_upgrade", "downgrade")).alias("version_changes"))
    full = seen.join(changes, "id").join(F.broadcast(last))
    return full.select("id", "first_seen", "last_seen", (F.col("last_seen") == F.col("newest")).alias("still_present"), (F.col("first_seen") > F.col("oldest")).alias("was_added"), "version_changes")


def trends(t: Tables) -> DataFrame:
    """Components, edges, direct edges (from roots) and vulnerabilities by severity of each document."""
    into = t.edges.select("sbom_id", F.col("to_id").alias("from_id")).distinct()
    direct = t.edges.join(into, ["sbom_id", "from_id"], "left_anti").groupBy("sbom_id").agg(F.count("*").alias("direct_edges"))
    n = t.components.groupBy("sbom_id").agg(F.count("*").alias("components"))
    e = t.edges.groupBy("sbom_id").agg(F.count("*").alias("edges"))
    v = t.vulns.groupBy("sbom_id").agg(F.count("*").alias("vulns"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return n.join(e, "sbom_id", "left").join(direct, "sbom_id", "left").join(v, "sbom_id", "left").fillna(0)


def similarity_matrix(t: Tables) -> DataFrame:
    """``a, b, shared, jaccard`` of the ids of every two documents, found by counting shared ids.

    Documents that share nothing have similarity 0 and still a row: a matrix is
    documents x documents by definition.
    """
    ids = t.components.select("sbom_id", "id").distinct()
    sizes = ids.groupBy("sbom_id").agg(F.count("*").alias("n"))
    shared = ids.withColumnRenamed("sbom_id", "a").join(ids.withColumnRenamed("sbom_id", "b"), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    every = sizes.select(F.col("sbom_id").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("sbom_id").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    full = every.join(shared, ["a", "b"], "left").fillna(0, ["shared"])
    return full.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def similar_documents(t: Tables, threshold: float) -> DataFrame:
    """``a, b, shared, jaccard`` of the documents whose ids have Jaccard similarity >= ``threshold``, without a matrix."""
    return similar_sets(t.components.select(F.col("sbom_id").alias("set_id"), F.col("id").alias("token")), threshold)


def leader_clusters(documents: DataFrame, near: DataFrame) -> DataFrame:
    """``sbom_id, leader, members, similarity, outlier``: greedy clusters in id order, as in a single pass over the matrix.

    ``documents`` has all ``sbom_id``, ``near`` the pairs ``a < b, jaccard`` over
    the threshold.  A document goes to the first leader near it; the pass is
    sequential by definition and runs on the connected groups of near documents
    one by one, in time linear in their pairs.  ``similarity`` is the members'
    mean similarity to their leader (1 for the leader itself); a document alone
    is an outlier.
    """
    near = materialize(near.select("a", "b", "jaccard"), "near-documents")
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = documents.select(F.col("sbom_id").alias("id"), F.col("sbom_id").alias("grp")).distinct()
    while True:
        offer = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("grp").alias("offer"))
        closer = labels.join(offer, "id", "left").select("id", F.least("grp", F.coalesce("offer", "grp")).alias("grp"), F.col("grp").alias("old"))
        new = materialize(closer, "leader-groups")
        labels = new.drop("old")
        if new.where("grp <> old").isEmpty():
            break

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, list[tuple[int, float]]] = {}
        for i, j, x in zip(pdf["id"], pdf["near"], pdf["jaccard"], strict=True):
            after.setdefault(int(i), [])
            if j == j and j is not None:
                after[int(i)].append((int(j), float(x)))
        leader: dict[int, tuple[int, float]] = {}
        for i in sorted(after):
            if i not in leader:
                leader[i] = (i, 1.0)
                for j, x in after[i]:
                    leader.setdefault(j, (i, x))
        return pd.DataFrame({"sbom_id": list(leader), "leader": [v[0] for v in leader.values()], "own": [v[1] for v in leader.values()]})

    rows = labels.join(near.select(F.col("a").alias("id"), F.col("b").alias("near"), "jaccard"), "id", "left")
    led = rows.groupBy("grp").applyInPandas(lead, f"sbom_id {dict(documents.dtypes)['sbom_id']}, leader {dict(documents.dtypes)['sbom_id']}, own double")
    sizes = led.groupBy("leader").agg(F.count("*").alias("members"), F.avg("own").alias("similarity"))
    return led.join(sizes, "leader").select("sbom_id", "leader", "members", "similarity", (F.col("members") == 1).alias("outlier"))
