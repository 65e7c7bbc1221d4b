"""Rule tables applied to components: exclusions, equivalences, aliases, name hygiene."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions import text as tx
from bomloom.operators.set_join import similarity_join
from bomloom.runtime import materialize


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: * any text, ? one character, all else as it stands."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def first_rule(components: DataFrame, rules: list[tuple[str, str, str]], column: str = "purl") -> DataFrame:
    """The first of ``(rule_id, kind, pattern)`` that matches each component; kind is exact, glob or regex.

    Rules are parameters: they become one CASE in the projection, in their order.
    """
    out = None
    for rule, kind, pattern in rules:
        hit = F.col(column) == pattern if kind == "exact" else F.col(column).rlike(glob_pattern(pattern) if kind == "glob" else pattern)
        out = F.when(hit, rule) if out is None else out.when(hit, rule)
    return components.withColumn("rule_id", out if out is not None else F.lit(None).cast("string"))


def excluded(components: DataFrame, rules: list[tuple[str, str, str]], column: str = "purl") -> DataFrame:
    """Components that no exclusion rule matches; their edges are another table and stay."""
    return first_rule(components, rules, column).where("rule_id is null").drop("rule_id")


def canonical_ids(components: DataFrame, aliases: DataFrame) -> DataFrame:
    """``canonical`` of each component by a table ``alias, canonical`` of purls: itself if it has none.

    Ids stay what they are, so equal canonical ids can be matched without losing
    a component; of several canonicals of one alias the smallest stands.
    """
    one = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.min("canonical").alias("canonical"))
    return components.join(one, F.lower("purl") == F.col("alias"), "left").withColumn("canonical", F.coalesce("canonical", "purl", "id")).drop("alias")


def lookalikes(components: DataFrame, well_known: DataFrame, most_edits: int = 1) -> DataFrame:
    """Names one slip away from a well-known name (``name``) of their ecosystem, and not it: possible typosquats.

    Names and well-known names meet where they are equal without one letter.
    """
    def cuts(n):
        return F.array_distinct(F.concat(F.array(n), F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))))

    low = F.lower("name")
    a = components.where(F.length("name") > 0).select("sbom_id", "id", "ecosystem", low.alias("n"), F.explode(cuts(low)).alias("cut"))
    b = well_known.where(F.length("name") > 0).select("ecosystem", low.alias("known"), F.explode(cuts(low)).alias("cut"))
    near = a.join(b, ["ecosystem", "cut"]).where("n <> known").select("sbom_id", "id", "n", "known").distinct()
    genuine = well_known.select("ecosystem", low.alias("n")).distinct()
    own = a.select("sbom_id", "id", "ecosystem").distinct()
    return near.where(F.levenshtein("n", "known") <= most_edits + 1).join(own, ["sbom_id", "id"]).join(genuine, ["ecosystem", "n"], "left_anti").select("sbom_id", "id", F.col("n").alias("name"), "known")


def minhash_pairs(left: DataFrame, right: DataFrame, threshold: float, bands: int = 20, rows: int = 3) -> DataFrame:
    """``left_id, right_id, jaccard, estimate, same_band`` of all names whose trigram sets have Jaccard similarity >= ``threshold``.

    Both sides need ``id, name``.  MinHash bands alone miss a pair at the
    threshold with probability (1 - t^rows)^bands, so the pairs come from the
    exact prefix-filter join, and the signatures tell what bands and estimate
    (share of equal minima) would have said.  The hash functions are fixed, so
    runs agree.  Names are made distinct first, so equal names meet once.
    """
    def signed(d: DataFrame) -> DataFrame:
        grams = d.where(F.length("name") > 0).select(F.lower("name").alias("id")).distinct().withColumn("tokens", tx.trigrams(F.col("id")))
        return materialize(grams.withColumn("signature", F.array(*[F.array_min(F.transform("tokens", _seeded(k))) for k in range(bands * rows)])), "signatures")

    x, y = signed(left), signed(right)
    close = similarity_join(x.select("id", "tokens"), y.select("id", "tokens"), threshold)
    side = lambda d, s: d.select(F.col("id").alias(f"{s}_id"), F.col("signature").alias(s))
    both = close.join(side(x, "left"), "left_id").join(side(y, "right"), "right_id")
    equal = F.zip_with("left", "right", lambda p, q: (p == q).cast("int"))
    band = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.forall(F.slice(equal, b * rows + 1, rows), lambda e: e == 1))
    told = both.select("left_id", "right_id", "jaccard", (F.aggregate(equal, F.lit(0), lambda s, e: s + e) / (bands * rows)).alias("estimate"), band.alias("same_band"))
    ids = lambda d, c, out: d.select(F.lower("name").alias(c), F.col("id").alias(out))
    named = told.withColumnsRenamed({"left_id": "x", "right_id": "y"}).join(ids(left, "x", "left_id"), "x").join(ids(right, "y", "right_id"), "y")
    return named.select("left_id", "right_id", "jaccard", "estimate", "same_band")


def _seeded(k: int):
    return lambda g: F.xxhash64(F.lit(k), g)


def latest_rule_use(applied: DataFrame) -> DataFrame:
    """How often each rule was used, and its first component by id."""
    w = Window.partitionBy("rule_id").orderBy("sbom_id", "id")
    return applied.where("rule_id is not null").withColumn("n", F.row_number().over(w)).groupBy("rule_id").agg(F.count("*").alias("uses"), F.min_by("id", "n").alias("first_id"))
