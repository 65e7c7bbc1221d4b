"""Set-similarity join with prefix, length and positional filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.runtime import materialize


def letter_tokens(text: Column) -> Column:
    """A text's distinct tokens: padded letter pairs, and its letters numbered by occurrence.

    Pairs hold the order, numbered letters survive transpositions; together a
    slip or two leaves most of a short word's tokens alone.  Null has no tokens.
    """
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    letters = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c, i: F.concat(c, F.lit("#"), (F.length(F.substring(text, F.lit(1), i)) - F.length(F.replace(F.substring(text, F.lit(1), i), c))).cast("string")),
    )
    return F.array_distinct(F.concat(pairs, letters))


def _ranked(sets: DataFrame, order: DataFrame) -> DataFrame:
    """``id, n, token, at``: each set's tokens with their place in global rarity order."""
    w = Window.partitionBy("id").orderBy("freq", "token")
    exploded = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(order, "token")
    return exploded.select("id", "n", "token", (F.row_number().over(w) - 1).alias("at"))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of ``left`` and ``right`` sets with Jaccard similarity >= ``threshold``.

    Both sides need ``id`` (unique) and ``tokens`` (distinct strings).  Tokens
    are ordered by rarity over both sides; two sets that reach the threshold
    share one of their first ``n - ceil(t n) + 1`` tokens, so only those are
    joined.  The length filter and the positional filter (the tokens left after
    the common one must suffice) thin the pairs out before their exact check.
    Empty sets match nothing; the result is ``left_id, right_id, jaccard``.
    """
    t = F.lit(float(threshold))
    sides = [s.where(F.size("tokens") > 0) for s in (left, right)]
    order = sides[0].select(F.explode("tokens").alias("token")).unionByName(sides[1].select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("freq"))
    a, b = (_ranked(s, order).where(F.col("at") < F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1) for s in sides)
    a = a.select("token", F.col("id").alias("left_id"), F.col("n").alias("ln"), F.col("at").alias("la"))
    b = b.select("token", F.col("id").alias("right_id"), F.col("n").alias("rn"), F.col("at").alias("ra"))
    needed = F.ceil(t / (1 + t) * (F.col("ln") + F.col("rn")) - 1e-9)
    close = a.join(b, "token").where((F.col("rn") >= t * F.col("ln") - 1e-9) & (F.col("ln") >= t * F.col("rn") - 1e-9))
    # at the first common token of the two prefixes, nothing before it is common
    first = close.groupBy("left_id", "right_id").agg(F.min(F.struct("la", "ra", "ln", "rn")).alias("p"), F.count("*").alias("seen"))
    reach = F.col("seen") + F.least(F.col("p.ln") - F.col("p.la"), F.col("p.rn") - F.col("p.ra")) - 1
    pairs = first.select("left_id", "right_id", reach.alias("reach"), F.col("p.ln").alias("ln"), F.col("p.rn").alias("rn")).where(F.col("reach") >= needed).select("left_id", "right_id")
    full = pairs.join(sides[0].select(F.col("id").alias("left_id"), F.col("tokens").alias("lt")), "left_id").join(sides[1].select(F.col("id").alias("right_id"), F.col("tokens").alias("rt")), "right_id")
    common = F.size(F.array_intersect("lt", "rt"))
    return full.withColumn("jaccard", common / (F.size("lt") + F.size("rt") - common)).where(F.col("jaccard") >= t - 1e-9).select("left_id", "right_id", "jaccard")


def similar_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, shared, jaccard`` of all sets ``a < b`` with Jaccard similarity >= ``threshold``, from rows ``set_id, token``.

    As ``similarity_join``, for sets too large for an array: a set's prefix is
    found by a sort, and the tokens of candidate pairs alone are joined again.
    Repeated rows count once, nulls are no tokens.
    """
    t = F.lit(float(threshold))
    rows = materialize(rows.where("set_id is not null and token is not null").select("set_id", "token").distinct(), "sets")
    freq = rows.groupBy("token").agg(F.count("*").alias("freq"))
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("freq", "token")) - 1
    ordered = rows.join(freq, "token").withColumn("at", place).join(sizes, "set_id").where(F.col("at") < F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1)
    side = lambda d, s: d.select("token", F.col("set_id").alias(s), F.col("n").alias(f"n{s}"), F.col("at").alias(f"at{s}"))
    met = side(ordered, "a").join(side(ordered, "b"), "token").where("a < b")
    met = met.where((F.col("na") >= t * F.col("nb") - 1e-9) & (F.col("nb") >= t * F.col("na") - 1e-9))
    first = met.groupBy("a", "b", "na", "nb").agg(F.min("ata").alias("ata"), F.min("atb").alias("atb"), F.count("*").alias("seen"))
    reach = F.col("seen") - 1 + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    pairs = first.where(reach >= F.ceil(t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-9)).select("a", "b", "na", "nb")
    both = pairs.join(rows.withColumnRenamed("set_id", "a"), "a").join(rows.withColumnRenamed("set_id", "b"), ["b", "token"])
    shared = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    scored = shared.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return scored.where(F.col("jaccard") >= t - 1e-9).select("a", "b", "shared", "jaccard")
