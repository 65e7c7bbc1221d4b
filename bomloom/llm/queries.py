"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomloom.llm import canonical_list, entity_match, format_dupes, mixing, packing, pii
from bomloom.llm.sql import SQL
from bomloom.runtime import table


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [table(spark, sf_dir, t) for t in ("inventory", "spdx_packages", "vuln_components")]
    return entity_match.match_releases(entity_match.listings(*tables))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir).where("confidence >= 0.5").select("rec_id_a", "rec_id_b")


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cdx_components")
    found = format_dupes.copies(rows, "comp_id", format_dupes.component_key())
    return found.select("keep_id", F.col("copy_id").alias("comp_id"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cdx_components")
    return format_dupes.representatives(rows, "comp_id", format_dupes.component_key())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "license_list")
    values = canonical_list.licence_values(table(spark, sf_dir, "spdx_packages"), table(spark, sf_dir, "inventory"), entries)
    return canonical_list.map_to_list(values, "value", entries).select("rec_id", "field_name", "pos", "license_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


#: Sources that p7_apart keeps out of each other's containers.
APART = {"advisory": {"licence_notice"}, "vex_statement": {"build_log", "mailing_list"}}


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"), apart=APART)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


QUERIES = {
    "p7_packed": p7_packed,
    "p7_apart": p7_apart,
    "p7_fill": p7_fill,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
    "p1_found": p1_found, "p1_confidence": p1_confidence, "p2_found": p2_found, "p2_records": p2_records, "p6_found": p6_found}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
