"""Free-entered values to the entries of a reference list.

Values and entries are split into a stem, a version and a suffix.  Distinct
stems meet the entries' written forms in a prefix-filter set-similarity join;
the group with the highest exact Jaccard similarity is kept, its form is checked
by edit distance, and version and suffix then have to single out one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.operators.set_join import letter_tokens, similarity_join
from bomloom.runtime import materialize

UNMATCHED = "UNMATCHED"

# Words of licence titles without meaning of their own, and abbreviations.
NOISE = ["the", "under", "licensed", "terms", "of", "license", "licence", "lic", "lizenz", "licencia", "licenza", "std", "see"]
ABBREVIATIONS = {
    "pub": "public",
    "publ": "public",
    "doc": "documentation",
    "docs": "documentation",
    "lib": "library",
    "attrib": "attribution",
    "comm": "community",
    "sw": "software",
    "softw": "software",
    "perm": "permissive",
    "inst": "institute",
}

_LATER = r"\s*(?:\+|\(?\b(?:or|and)\s+(?:any\s+)?(?:later|newer|higher|above)(?:\s+versions?)?\b\)?)[\s.)]*$"
_ONLY = r"\s*\(?\b(?:this\s+version\s+)?only\b\)?[\s.]*$"
_VERSION = r"^(.*?)(?:\b(?:version|ver|v)\b\.?\s*|v)?\(?\s*([0-9]+(?:\.[0-9]+)*)\s*\)?[\s.]*$"


def parts(value: Column, expand: bool = True) -> Column:
    """STRUCT<words ARRAY<STRING>, version STRING, suffix STRING> of a written licence."""
    text = F.regexp_replace(F.lower(value), r"^[\s\p{Z}\[\"'“(]+|[\s\p{Z}\]\"'”.]+$", "")
    page = F.regexp_extract(text, r"([^/]+?)(?:\.[a-z]{2,5})?/*$", 1)
    text = F.when(text.rlike(r"^https?://"), page).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"(?:[\s\p{Z}_/,:;\[\]\"'“”\-]|(?<![0-9])\.|\.(?![0-9]))+", " "))
    suffix = F.when(text.rlike(_LATER), "later").when(text.rlike(_ONLY), "only")
    bare = F.regexp_replace(F.regexp_replace(text, _LATER, ""), _ONLY, "")
    number = F.regexp_extract(bare, _VERSION, 2)
    stem = F.when(number != "", F.regexp_extract(bare, _VERSION, 1)).otherwise(bare)
    words = F.filter(F.split(stem, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(NOISE))
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    if expand:
        words = F.transform(words, lambda w: F.coalesce(full[w], w))
    return F.struct(words.alias("words"), _two_places(number).alias("version"), suffix.alias("suffix"))


def _two_places(number: Column) -> Column:
    """2 -> 2.0, 2.0.0 -> 2.0; an empty text is no version."""
    shortened = F.regexp_replace(number, r"(?:\.0+)+$", "")
    return F.when(number == "", None).when(shortened.contains("."), shortened).otherwise(F.concat(shortened, F.lit(".0")))


def _list_forms(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries by group, version and suffix, and the written forms of each group."""
    split = entries.where("license_id is not null").select("license_id", parts(F.col("license_id")).alias("i"), parts(F.col("license_id"), expand=False).alias("raw"), parts(F.col("name")).alias("n"))
    group = F.array_join("i.words", "")
    known = split.select(group.alias("grp"), "license_id", F.col("i.version").alias("e_version"), F.col("i.suffix").alias("e_suffix"))
    code = F.array_join(F.slice("i.words", 2, 9), "")
    title, head = F.array_join("n.words", ""), F.element_at("n.words", 1)
    tail = F.array_join(F.slice("n.words", 2, 99), "")
    forms = F.array(group, F.array_join("raw.words", ""), title, F.concat(title, code), F.concat(tail, head), F.concat(tail, head, code))
    written = split.select(group.alias("grp"), F.explode(forms).alias("form"))
    return known, written.where("form is not null and form <> ''").distinct()


def map_to_list(values: DataFrame, value: str, entries: DataFrame, threshold: float = 0.4, most_edits: float = 0.4) -> DataFrame:
    """``values`` with a column ``license_id``: the entry meant, or ``UNMATCHED``.

    ``entries`` needs ``license_id`` and ``name``.  A stem is taken for the group
    of entries with the highest Jaccard similarity of a form to it, at least
    ``threshold`` (ties: fewer edits); no other group may be as near.  The form
    must then be within ``most_edits`` edits for each letter of the longer text,
    as sets of letter pairs alone don't tell an anagram from a slip.
    Without a version the group must have one entry; without a suffix the
    version must have one entry or one without suffix.  Null and empty values
    and values of other things are ``UNMATCHED``; repeated rows stay repeated;
    an empty list leaves all unmatched.
    """
    known, forms = _list_forms(entries)
    split = values.withColumn("_p", parts(F.col(value))).withColumn("_stem", F.coalesce(F.array_join("_p.words", ""), F.lit("")))
    stems = split.where("_stem <> ''").select(F.col("_stem").alias("id")).distinct().withColumn("tokens", letter_tokens(F.col("id")))
    stems = materialize(stems, "stems")
    shapes = forms.select(F.col("form").alias("id")).distinct().withColumn("tokens", letter_tokens(F.col("id")))
    near = similarity_join(stems, shapes, threshold).join(forms.withColumnRenamed("form", "right_id"), "right_id")
    near = near.withColumn("edits", F.levenshtein("left_id", "right_id")).withColumn("far", F.round(-F.col("jaccard"), 12))
    near = near.withColumn("allowed", most_edits * F.greatest(F.length("left_id"), F.length("right_id")))
    per_group = near.groupBy("left_id", "grp").agg(F.min(F.struct("far", "edits", "allowed")).alias("how"))
    w = Window.partitionBy("left_id").orderBy("how.far", "how.edits")
    best = per_group.withColumn("place", F.rank().over(w)).where("place = 1").groupBy(F.col("left_id").alias("_stem")).agg(F.count("*").alias("groups"), F.first("grp").alias("grp"), F.first("how").alias("how"))
    best = best.where("groups = 1 and how.edits <= how.allowed").select("_stem", "grp")
    # a group's options are the entries that differ in version and suffix alone
    options = known.groupBy("grp").agg(F.collect_list(F.struct("license_id", "e_version", "e_suffix")).alias("options"))
    matched = best.join(options, "grp").select("_stem", "options")
    found = split.join(matched, "_stem", "left")
    at_version = F.filter("options", lambda e: F.col("_p.version").isNull() | (e["e_version"] == F.col("_p.version")))
    exact = F.filter(at_version, lambda e: e["e_suffix"].eqNullSafe(F.col("_p.suffix")))
    # "only" adds nothing where the list knows no "or later"
    plain = F.when(F.col("_p.suffix").eqNullSafe("only"), F.filter(at_version, lambda e: e["e_suffix"].isNull()))
    chosen = F.when(F.size(exact) > 0, exact).when(F.size(plain) > 0, plain).when(F.col("_p.suffix").isNull(), at_version)
    entry = F.when(F.size(chosen) == 1, chosen[0]["license_id"])
    return found.withColumn("license_id", F.coalesce(entry, F.lit(UNMATCHED))).drop("_p", "_stem", "options")


def licence_values(spdx_packages: DataFrame, inventory: DataFrame, license_list: DataFrame) -> DataFrame:
    """``rec_id, field_name, pos, value`` of the free-entered licences (neither null, NOASSERTION, NONE nor an id)."""
    two = F.array(F.struct(F.lit("declared").alias("field_name"), F.col("license_declared").alias("value")), F.struct(F.lit("concluded").alias("field_name"), F.col("license_concluded").alias("value")))
    packages = spdx_packages.select("rec_id", F.explode(two).alias("v")).select("rec_id", "v.field_name", F.lit(0).alias("pos"), "v.value")
    listed = inventory.select("rec_id", F.posexplode("licenses").alias("pos", "l")).select("rec_id", F.lit("license").alias("field_name"), "pos", F.col("l.license.id").alias("value"))
    entered = packages.unionByName(listed).where("value is not null and value not in ('NOASSERTION', 'NONE')")
    return entered.join(license_list.select(F.col("license_id").alias("value")), "value", "left_anti")
