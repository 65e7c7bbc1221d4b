"""Matching components of two documents: blocking, tiered scores, one-to-one assignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions import text as tx
from bomloom.functions.purl import name_normal, purl_normal
from bomloom.functions.version import boost_parts, lenient_parts, version_boost, version_divergence
from bomloom.runtime import materialize, partitions


@dataclass(frozen=True)
class Preset:
    threshold: float
    levenshtein: float
    jaro_winkler: float


# Thresholds and weights of the presets; weights of the fields.
PRESETS = {"strict": Preset(0.95, 0.5, 0.5), "balanced": Preset(0.85, 0.4, 0.6), "permissive": Preset(0.70, 0.3, 0.7)}
FIELD_WEIGHTS = {
    "balanced": {"name": 0.60, "version": 0.10, "ecosystem": 0.15, "licence": 0.08, "supplier": 0.04, "mismatch": -0.15},
    "security": {"name": 0.50, "version": 0.20, "ecosystem": 0.20, "licence": 0.05, "supplier": 0.03, "mismatch": -0.25},
}
CONFIDENCE_WIDTH = {"exact": 0.0, "alias": 0.02, "ecosystem_rule": 0.03, "fuzzy": 0.08, "none": 0.10}


def _keys(name: Column, ecosystem: Column) -> Column:
    n = name_normal(name, ecosystem)
    prefix = F.concat_ws("/", F.lit("p"), F.coalesce(ecosystem, F.lit("")), F.substring(n, 1, 3))
    grams = F.transform(tx.trigrams(n), lambda g: F.concat(F.lit("t/"), F.substring(n, 1, 1), g))
    return F.when(n != "", F.array_distinct(F.concat(F.array(prefix), grams)))


def blocks(components: DataFrame) -> DataFrame:
    """``sbom_id, id, key``: the keys under which a component meets candidates.

    The ecosystem with the first three letters of its normal name, and the
    normal name's trigrams with the first letter.
    """
    return components.select("sbom_id", "id", F.explode(_keys(F.col("name"), F.col("ecosystem"))).alias("key"))


def _aliased(old: DataFrame, new: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct ``na, ea, nb, eb`` of names that mean one canonical name by ``alias, canonical`` (letter case aside)."""
    low = aliases.select(F.lower("alias").alias("n"), F.lower("canonical").alias("canon"))
    known = low.unionByName(low.select(F.col("canon").alias("n"), "canon")).distinct()
    side = lambda d, n, e: d.select(F.col("name").alias(n), F.col("ecosystem").alias(e)).distinct().join(known, F.lower(F.col(n)) == F.col("n")).select(n, e, "canon").distinct()
    return side(old, "na", "ea").join(side(new, "nb", "eb"), "canon").drop("canon").distinct()


def _near_names(old: DataFrame, new: DataFrame, max_length_gap: int) -> DataFrame:
    """Distinct ``na, ea, nb, eb``: names with their ecosystems that share a block and are close in length."""
    keyed = lambda d, n, e: d.select(F.col("name").alias(n), F.col("ecosystem").alias(e)).distinct().withColumn("key", F.explode(_keys(F.col(n), F.col(e))))
    met = keyed(old, "na", "ea").join(keyed(new, "nb", "eb"), "key").drop("key").distinct()
    return met.where(F.abs(F.length("na") - F.length("nb")) <= max_length_gap)


def _meet(near: DataFrame, a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of both sides (``name, ecosystem`` as na, ea and nb, eb) whose names are near, within equal ``by``."""
    named = lambda d, x: d.withColumnsRenamed({"name": f"_n{x}", "ecosystem": f"_e{x}"})
    left = near.join(named(a, "a"), F.expr("na <=> _na and ea <=> _ea"))
    right = named(b, "b").withColumnsRenamed({c: f"_{c}" for c in by})
    return left.join(right, F.expr(" and ".join(["nb <=> _nb", "eb <=> _eb", *(f"{c} = _{c}" for c in by)]))).drop("_na", "_ea", "_nb", "_eb", *(f"_{c}" for c in by))


def candidates(old: DataFrame, new: DataFrame, max_length_gap: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``by, old_id, new_id`` that share a block and whose names' lengths are close.

    ``by`` are columns of both sides (the two documents), within which they meet.
    Blocks are joined for distinct names, so a pair of components comes up once.
    """
    side = lambda d, out: d.select(*by, "name", "ecosystem", F.col("id").alias(out)).distinct()
    return _meet(_near_names(old, new, max_length_gap), side(old, "old_id"), side(new, "new_id"), by).select(*by, "old_id", "new_id")


def cheap_tier(a: str, b: str) -> Column:
    """1.0 for equal normal purls, 0.90 for equal normal names of one ecosystem, else null."""
    col = lambda s, c: F.col(f"{s}.{c}")
    same_purl = purl_normal(col(a, "purl")) == purl_normal(col(b, "purl"))
    same_name = (col(a, "ecosystem") == col(b, "ecosystem")) & (name_normal(col(a, "name"), col(a, "ecosystem")) == name_normal(col(b, "name"), col(b, "ecosystem")))
    return F.when(same_purl, 1.0).when(same_name, 0.90)


def name_scores(pairs: DataFrame, preset: Preset = PRESETS["balanced"]) -> DataFrame:
    """Adds ``name_score`` to pairs with ``name_a, name_b``: computed once for each unordered pair of names.

    The largest of the weighted character scores, the token overlap, and 0.85
    times the phonetic agreement.  Only names that the built-in tests leave open
    go through the Arrow UDF.
    """
    x, y = F.lower("name_a"), F.lower("name_b")
    distinct = pairs.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).distinct()
    chars = tx.jaro_winkler(F.col("p"), F.col("q")) * preset.jaro_winkler + tx.levenshtein_similarity(F.col("p"), F.col("q")) * preset.levenshtein
    phonetic = F.greatest(tx.phonetic_similarity(F.col("p"), F.col("q")), tx.phonetic_similarity(F.col("q"), F.col("p")))
    scored = distinct.select("p", "q", F.greatest(chars, tx.token_similarity(F.col("p"), F.col("q")), 0.85 * phonetic).alias("name_score"))
    return pairs.withColumn("p", F.least(x, y)).withColumn("q", F.greatest(x, y)).join(scored, ["p", "q"], "left").drop("p", "q")


def score_pairs(pairs: DataFrame, old: DataFrame, new: DataFrame, preset: Preset = PRESETS["balanced"]) -> DataFrame:
    """``old_id, new_id, score, tier`` of candidate pairs; pairs below the threshold score 0 with tier none."""
    a, b = old.alias("a"), new.alias("b")
    full = pairs.join(a, F.col("old_id") == F.col("a.id")).join(b, F.col("new_id") == F.col("b.id"))
    slim = full.select("old_id", "new_id", cheap_tier("a", "b").alias("cheap"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), version_boost(F.col("a.version"), F.col("b.version")).alias("boost"))
    done = slim.where("cheap is not null").select("old_id", "new_id", F.col("cheap").alias("score"), F.when(F.col("cheap") == 1.0, "exact").otherwise("ecosystem_rule").alias("tier"))
    fuzzy = name_scores(slim.where("cheap is null"), preset).withColumn("s", F.least(F.col("name_score") + F.col("boost"), F.lit(1.0)))
    ok = F.col("s") >= preset.threshold
    return done.unionByName(fuzzy.select("old_id", "new_id", F.when(ok, F.col("s")).otherwise(0.0).alias("score"), F.when(ok, "fuzzy").otherwise("none").alias("tier")))


def alike(components: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, rep, id, name, ecosystem, version, purl``: components that score alike share ``rep``, their smallest id."""
    low = components.select(*by, "id", "name", "ecosystem", "version", purl_normal(F.col("purl")).alias("purl"))
    return materialize(low.withColumn("rep", F.min("id").over(Window.partitionBy(*by, "name", "ecosystem", "version", "purl"))), "alike")


def alike_scores(old: DataFrame, new: DataFrame, by: tuple[str, ...] = (), preset: Preset = PRESETS["balanced"], max_length_gap: int = 10, aliases: DataFrame | None = None) -> DataFrame:
    """``by, old_id, new_id, score, tier`` as of ``score_pairs``, for the ``rep`` of both sides of ``alike`` that are candidates.

    Names are scored once for a pair of names, the rest once for a pair of ``rep``.
    With ``aliases`` (alias, canonical) names of one canonical name are candidates
    too and score 0.95 unless their purls agree.
    """
    near = _near_names(old, new, max_length_gap).withColumn("alias", F.lit(False))
    if aliases is not None:
        near = near.unionByName(_aliased(old, new, aliases).withColumn("alias", F.lit(True))).groupBy("na", "ea", "nb", "eb").agg(F.max("alias").alias("alias"))
    same = (F.col("ea") == F.col("eb")) & (name_normal(F.col("na"), F.col("ea")) == name_normal(F.col("nb"), F.col("eb")))
    near = name_scores(near.withColumnsRenamed({"na": "name_a", "nb": "name_b"}), preset).withColumnsRenamed({"name_a": "na", "name_b": "nb"}).withColumn("same_name", same)
    near = materialize(near, "near-names")
    side = lambda d, x, out: d.where("id = rep").select(*by, "name", "ecosystem", F.col("id").alias(out), F.col("version").alias(f"v{x}"), F.col("purl").alias(f"p{x}"), boost_parts(F.col("version")).alias(f"s{x}"))
    met = _meet(near, side(old, "a", "old_id"), side(new, "b", "new_id"), by)
    s = F.least(F.col("name_score") + version_boost(F.col("va"), F.col("vb"), (F.col("sa"), F.col("sb"))), F.lit(1.0))
    exact, alias, rule, fuzzy = F.col("pa") == F.col("pb"), F.col("alias"), F.col("same_name"), s >= preset.threshold
    score = F.when(exact, 1.0).when(alias, 0.95).when(rule, 0.90).when(fuzzy, s).otherwise(0.0)
    return met.select(*by, "old_id", "new_id", score.alias("score"), F.when(exact, "exact").when(alias, "alias").when(rule, "ecosystem_rule").when(fuzzy, "fuzzy").otherwise("none").alias("tier"))


def all_scores(old: DataFrame, new: DataFrame, by: tuple[str, ...] = (), aliases: DataFrame | None = None) -> DataFrame:
    """``by, old_id, new_id, score, tier`` of all candidates of two sides."""
    a, b = alike(old, by), alike(new, by)
    scored = alike_scores(a, b, by, aliases=aliases).withColumnsRenamed({"old_id": "old_rep", "new_id": "new_rep"})
    member = lambda d, r, out: d.select(*by, F.col("rep").alias(r), F.col("id").alias(out))
    full = scored.join(member(a, "old_rep", "old_id"), [*by, "old_rep"]).join(member(b, "new_rep", "new_id"), [*by, "new_rep"])
    return full.select(*by, "old_id", "new_id", "score", "tier")


def _field_scores(old: DataFrame, new: DataFrame, weights: dict[str, float], by: tuple[str, ...], max_length_gap: int, keep: tuple[str, str]) -> DataFrame:
    """``by``, the columns ``keep`` (one of each side) and the multi-field ``score`` of all candidates.

    Names and ecosystems are compared once for a pair of names, versions parsed
    and texts lowered once for a row of a side: a pair only compares and adds.
    The old side is spread first, as its few rows are many pairs.  Pairs with a
    version that doesn't parse are scored apart: common prefixes are not compiled.
    """
    agree = lambda x, y: F.when(x.isNull() & y.isNull(), 0.5).when(x == y, 1.0).otherwise(0.0)
    side = lambda d, x, c: d.select(*by, c, "name", "ecosystem", F.col("version").alias(f"v{x}"), lenient_parts(F.col("version")).alias(f"p{x}"), F.lower("licence").alias(f"l{x}"), F.lower("supplier").alias(f"s{x}"))
    near = _near_names(old, new, max_length_gap).select(
        "na", "ea", "nb", "eb", (tx.levenshtein_similarity(F.col("na"), F.col("nb")) * weights["name"]).alias("name"),
        F.when(F.col("ea") != F.col("eb"), weights["mismatch"]).otherwise(0.0).alias("penalty"), (agree(F.lower("ea"), F.lower("eb")) * weights["ecosystem"]).alias("eco"),
    )
    a = side(old, "a", keep[0])
    met = _meet(near, a.repartition(partitions(old.sparkSession), *a.columns[: len(by) + 1]), side(new, "b", keep[1]), by)

    def scored(d: DataFrame, parsed: bool) -> DataFrame:
        version = version_divergence(F.col("va"), F.col("vb"), parts=(F.col("pa"), F.col("pb")), parsed=parsed)
        total = F.col("name") + version * weights["version"] + F.col("penalty") + F.col("eco")
        total = total + agree(F.col("la"), F.col("lb")) * weights["licence"] + agree(F.col("sa"), F.col("sb")) * weights["supplier"]
        return d.select(*by, *keep, (F.floor(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)) * 1e6 + 0.5) / 1e6).alias("score"))

    fine_a, fine_b = (F.col(f"v{x}").isNull() | F.col(f"p{x}").isNotNull() for x in "ab")
    return scored(met.where(fine_a & fine_b), True).unionByName(scored(met.where(~fine_a), False)).unionByName(scored(met.where(fine_a & ~fine_b), False))


def multi_field_scores(old: DataFrame, new: DataFrame, weights: dict[str, float], by: tuple[str, ...] = (), max_length_gap: int = 10) -> DataFrame:
    """``by, old_id, new_id, score`` of all candidates, to six places.

    Weighted name (edit distance), version, ecosystem, licence and supplier; a
    field missing on both sides counts half.
    """
    return _field_scores(old.withColumnRenamed("id", "old_id"), new.withColumnRenamed("id", "new_id"), weights, by, max_length_gap, ("old_id", "new_id"))


def multi_field_counts(old: DataFrame, new: DataFrame, weights: dict[str, float], by: tuple[str, ...] = (), max_length_gap: int = 10) -> DataFrame:
    """``score, n``: how many candidates have each score of ``multi_field_scores``.

    Components that score alike are counted before they meet; no pair is written or shuffled.
    """
    alike = lambda d, n: d.groupBy(*by, "name", "ecosystem", "version", "licence", "supplier").agg(F.count("*").alias(n))
    scored = _field_scores(alike(old, "old_n"), alike(new, "new_n"), weights, by, max_length_gap, ("old_n", "new_n"))
    return scored.groupBy("score").agg(F.sum(F.col("old_n") * F.col("new_n")).alias("n"))


def best_match(scored: DataFrame) -> DataFrame:
    """The best new component of each old one over the threshold, ties by id."""
    w = Window.partitionBy("old_id").orderBy(F.desc("score"), "new_id")
    return scored.where("score > 0").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def explained(scored: DataFrame) -> DataFrame:
    """Scores with the interval that their tier allows."""
    widths = F.create_map(*[F.lit(x) for kv in CONFIDENCE_WIDTH.items() for x in kv])
    width = widths[F.col("tier")]
    return scored.select("*", F.greatest(F.col("score") - width, F.lit(0.0)).alias("low"), F.least(F.col("score") + width, F.lit(1.0)).alias("high"))


def score_statistics(counts: DataFrame) -> DataFrame:
    """Of ``score, n`` (rounded scores: at most a million rows), each score counting ``n`` times."""
    all_rows = Window.partitionBy()
    c = counts.withColumn("mean", F.sum(F.col("score") * F.col("n")).over(all_rows) / F.sum("n").over(all_rows))
    number = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).cast("bigint")
    gap = F.col("score") - F.col("mean")
    return c.agg(
        number(F.lit(True)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.first("mean").alias("mean_score"), F.sqrt(F.sum(gap * gap * F.col("n")) / F.sum("n")).alias("std_score"),
        F.percentile("score", F.lit(0.5), F.col("n")).alias("median_score"), number(F.col("score") >= 0.9999).alias("exact"), number(F.col("score") <= 0.0).alias("zero"),
    )


def ratio_threshold(counts: DataFrame, ratio: float) -> DataFrame:
    """Of ``score, n``: the smallest score up to which there is a share of 1 - ``ratio`` of them."""
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)  # rounded scores: at most a million rows
    c = counts.select("score", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return c.where(F.col("upto") / F.col("total") >= 1 - ratio).agg(F.min("score").alias("threshold"))


def block_statistics(components: DataFrame, by: tuple[str, ...] = ("sbom_id",)) -> DataFrame:
    """Blocks of each document: how many, the largest and the mean number of components in one."""
    sizes = blocks(components).groupBy(*by, "key").agg(F.count_distinct("id").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("blocks"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


def otsu_threshold(scored: DataFrame, bins: int = 100) -> DataFrame:
    """The threshold that parts the scores best (largest variance between classes), from a histogram."""
    hist = scored.select(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    all_rows = Window.partitionBy()
    c = hist.select("bin", F.sum("n").over(w).alias("below"), F.sum(F.col("n") * F.col("bin")).over(w).alias("mass"), F.sum("n").over(all_rows).alias("total"), F.sum(F.col("n") * F.col("bin")).over(all_rows).alias("all_mass"))
    c = c.where("below < total")
    gap = F.col("mass") / F.col("below") - (F.col("all_mass") - F.col("mass")) / (F.col("total") - F.col("below"))
    spread = c.select("bin", F.round(F.col("below") * (F.col("total") - F.col("below")) * gap * gap, 6).alias("between"))
    best = spread.agg(F.max("between").alias("between"))
    return spread.join(F.broadcast(best), "between").agg(((F.min("bin") + F.max("bin")) / 2.0 / bins + 0.5 / bins).alias("threshold"))


def _hungarian(score: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns with the largest sum; entries of 0 are no pairs.  Dense: the tests hold ``_transport`` against it."""
    n, m = score.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = np.where(score > 0, -(1 + score), 0)
    u, v, way, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, dtype=int), np.zeros(size + 1, dtype=int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used
            free[0] = False
            slack = cost[i0] - u[i0] - v
            better = free & (slack < least)
            least[better], way[better] = slack[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if 0 < match[j] <= n and score[match[j] - 1, j - 1] > 0]


def _transport(supply: list[int], free: list[int], near: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[int, int]]:
    """Units of each column's rows (row -> units) with the largest sum of 1 + score: shortest augmenting paths.

    Row ``i`` has ``supply[i]`` units and may use the columns ``near[i][0]`` at the
    scores ``near[i][1]``; a unit without column costs nothing.  Only the given
    pairs are held, so memory grows with them and not with rows times columns.
    """
    m = len(free)
    u, v, free = np.array([min(0.0, float(np.min(-1 - w))) for _, w in near]), np.zeros(m), np.array(free)
    flow: list[dict[int, int]] = [{} for _ in range(m)]
    for first, left in enumerate(supply):
        u[first] = min(0.0, float(np.min(-1 - near[first][1] - v[near[first][0]])))
        while left:
            dist, way, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
            base, via, todo, none = {first: 0.0}, {}, [first], (np.inf, -1)
            while True:
                for r in todo:
                    cols, w = near[r]
                    d = np.maximum(base[r] - 1 - w - u[r] - v[cols], base[r])
                    closer = (d < dist[cols]) & ~done[cols]
                    dist[cols[closer]], way[cols[closer]] = d[closer], r
                    none = min(none, (base[r] - u[r], r))
                ahead = np.where(done, np.inf, dist)
                least = ahead.min()
                if none[0] <= least:
                    end, delta = -1, none[0]
                    break
                at = np.flatnonzero(ahead <= least)
                open_ = at[free[at] > 0]
                if len(open_):
                    end, delta = int(open_[0]), least
                    break
                todo = []
                for j in at.tolist():
                    done[j] = True
                    for r in flow[j]:
                        if r not in base:
                            base[r], via[r] = least, j
                            todo.append(r)
            v[done] -= delta - dist[done]
            for r, x in base.items():
                u[r] += delta - x
            steps, r = [], none[1] if end < 0 else int(way[end])  # from the end back to the first row
            units = left if end < 0 else min(left, int(free[end]))
            while r != first:
                steps.append((r, via[r]))
                units = min(units, flow[via[r]][r])
                r = int(way[via[r]])
            r = none[1] if end < 0 else int(way[end])
            if end >= 0:
                free[end] -= units
                flow[end][r] = flow[end].get(r, 0) + units
            for r, j in steps:
                flow[j][r] -= units
                if not flow[j][r]:
                    del flow[j][r]
                other = int(way[j])
                flow[j][other] = flow[j].get(other, 0) + units
            left -= units
    return flow


def _optimal(pairs: pd.DataFrame, olds: dict[str, list[str]], news: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    rows, cols = sorted(olds), sorted(news)
    at = {x: i for i, x in enumerate(cols)}
    by_row = {o: (g["new_id"].map(at).to_numpy(), g["score"].to_numpy()) for o, g in pairs.sort_values(["old_id", "new_id"]).groupby("old_id")}
    near = [by_row[r] for r in rows]
    flow = _transport([len(olds[r]) for r in rows], [len(news[c]) for c in cols], near)
    used, out = dict.fromkeys(rows, 0), []
    for j, c in enumerate(cols):
        first = 0
        for i, units in sorted(flow[j].items()):
            score = float(near[i][1][np.flatnonzero(near[i][0] == j)[0]])
            out += [(olds[rows[i]][used[rows[i]] + k], news[c][first + k], score) for k in range(units)]
            used[rows[i]] += units
            first += units
    return out


def assign(scored: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = (), alike_sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One-to-one matches with the largest sum of 1 + score, within ``by``.

    Solved exactly, at any size, for each group of ``groups`` (old_id, grp), else
    for each connected component of the pairs.  ``alike_sides`` as in ``greedy_assign``.
    """
    return _by_group(scored, groups, by, alike_sides, _optimal)


def connected(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, old_id, grp``: the connected components of the scored pairs, named by their smallest old id."""
    pairs = scored.select(*by, "old_id", "new_id")
    labels = materialize(pairs.select(*by, "old_id", F.col("old_id").alias("grp")).distinct(), "groups-0")
    n = 0
    while True:
        n += 1
        there = pairs.join(labels, [*by, "old_id"]).groupBy(*by, "new_id").agg(F.min("grp").alias("grp"))
        back = pairs.join(there, [*by, "new_id"]).groupBy(*by, "old_id").agg(F.min("grp").alias("grp"))
        jump = back.select(*by, F.col("old_id").alias("grp"), F.col("grp").alias("further"))
        new = back.join(jump, [*by, "grp"], "left").select(*by, "old_id", F.least("grp", F.coalesce("further", "grp")).alias("grp"))
        new = materialize(new, f"groups-{n}")
        if new.join(labels.withColumnRenamed("grp", "was"), [*by, "old_id"]).where("grp <> was").isEmpty():
            return new
        labels = new


def _by_group(scored: DataFrame, groups: DataFrame | None, by: tuple[str, ...], alike_sides: tuple[DataFrame, DataFrame] | None, solve) -> DataFrame:
    """``solve(pairs, ids of each old rep, ids of each new rep)`` for every connected group of candidates."""
    edges = materialize(scored.where("score > 0").select(*by, "old_id", "new_id", "score"), "scored")
    edges = materialize(edges.join(connected(edges, by) if groups is None else groups, [*by, "old_id"]), "grouped")
    held = []
    for side, c in enumerate(("old_id", "new_id")):
        reps = edges.select(*by, "grp", F.col(c).alias("rep")).distinct()
        ids = reps.withColumn("id", F.col("rep")) if alike_sides is None else reps.join(alike_sides[side].select(*by, "rep", "id"), [*by, "rep"])
        held.append(ids.select(*by, "grp", "rep", "id", F.lit(side).alias("side")))

    held = materialize(held[0].unionByName(held[1]), "grouped-ids")

    def run(key: tuple, pairs: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        ids = ids.sort_values("id")
        olds, news = ({r: list(g) for r, g in ids[ids["side"] == i].groupby("rep")["id"]} for i in (0, 1))
        out = pd.DataFrame(solve(pairs, olds, news), columns=["old_id", "new_id", "score"])
        for at, c in enumerate(by):
            out.insert(at, c, key[at])
        return out

    ddl = ", ".join([*(f"{c} {scored.schema[c].dataType.simpleString()}" for c in by), "old_id string, new_id string, score double"])
    return edges.groupBy(*by, "grp").cogroup(held.groupBy(*by, "grp")).applyInPandas(run, ddl)


def _greedy(pairs: pd.DataFrame, olds: dict[str, list[str]], news: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    """By score, then old id, then new id: within one score every old takes its smallest new that is left."""
    out, taken, next_new = [], set(), dict.fromkeys(news, 0)
    for score, level in sorted(pairs.groupby("score"), key=lambda x: -x[0]):
        near = {o: list(g) for o, g in level.groupby("old_id")["new_id"]}
        for old, rep in sorted((x, r) for r in near for x in olds[r] if x not in taken):
            near[rep] = [n for n in near[rep] if next_new[n] < len(news[n])]
            if near[rep]:
                n = min(near[rep], key=lambda n: news[n][next_new[n]])
                out.append((old, news[n][next_new[n]], score))
                taken.add(old)
                next_new[n] += 1
    return out


def greedy_assign(scored: DataFrame, by: tuple[str, ...] = (), alike_sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One-to-one matches, best score first, ties by old and new id, within ``by``.

    With ``alike_sides`` the pairs are of the ``rep`` of ``alike`` and stand for all ids that share it.
    """
    return _by_group(scored, None, by, alike_sides, _greedy)


def equivalents(components: DataFrame, families: DataFrame, penalty: float = 0.10, minimum: float = 0.80) -> DataFrame:
    """The same library in another ecosystem, by a table ``family, ecosystem, name, score`` of package families."""
    low = families.select("family", F.col("ecosystem").alias("eco"), F.lower("name").alias("n"), "score")
    own = components.join(low, (F.col("ecosystem") == F.col("eco")) & (F.lower("name") == F.col("n"))).select("sbom_id", "id", "family", "eco")
    other = low.select("family", F.col("eco").alias("other_eco"), F.col("n").alias("other_name"), "score")
    found = own.join(other, "family").where("eco <> other_eco").withColumn("score", F.col("score") - penalty)
    return found.where(F.col("score") >= minimum).select("sbom_id", "id", "family", F.col("other_eco").alias("ecosystem"), F.col("other_name").alias("name"), "score")
