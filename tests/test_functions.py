import pytest
from pyspark.sql import functions as F

from bomloom.functions import licence, purl, text, version


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("name", "code"), [("lodash-es", "L320"), ("123", ""), ("", ""), ("react", "R230"), ("request", "R230"), ("Pfister", "P236")])
def test_soundex(spark, name, code):
    assert value(spark, text.soundex(F.lit(name))) == code


def test_similarities(spark):
    lit = F.lit
    assert value(spark, text.token_similarity(lit("react-dom"), lit("dom-react"))) == 1.0
    assert value(spark, text.token_similarity(lit(""), lit("a"))) == 0.0
    assert value(spark, text.levenshtein_similarity(lit(""), lit(""))) == 1.0
    assert round(value(spark, text.jaro_winkler(lit("martha"), lit("marhta"))), 4) == 0.9611
    assert value(spark, text.jaro_winkler(lit(None).cast("string"), lit("a"))) is None
    d = value(spark, text.inline_difference(lit("1.2.3"), lit("1.9.3")))
    assert (d.prefix, d.suffix) == (2, 2)


@pytest.mark.parametrize(
    ("v", "req", "ok"),
    [("1.2.3", ">=1.2, <2", True), ("2.0.0", ">=1.2, <2", False), ("1.4.9", "~1.4", True), ("1.5.0", "~1.4", False), ("0.3.9", "^0.3", True), ("0.4.0", "^0.3", False), ("1.9.0", "1.*", True),
     ("1.2.3-rc1", ">=1.2", False), ("1.2.3-rc2", ">=1.2.3-rc1", True), ("abc", ">=1", False), (None, ">=1", False), ("1.0.0", "=1.0.0", True), ("1.0.1", ">1.0.0", True), ("2.1.0", "<=2", True)],
)
def test_requirements(spark, v, req, ok):
    assert value(spark, version.matches_requirement(F.lit(v).cast("string"), req)) is ok


def test_versions(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert value(spark, version.version_divergence(lit("1.2.3"), lit("1.2.9"))) == pytest.approx(0.74)
    assert value(spark, version.version_divergence(lit(None), lit(None))) == 0.5
    assert value(spark, version.version_divergence(lit("abcx"), lit("abcy"))) == pytest.approx(0.375)
    assert value(spark, version.change_class(lit("1.2.3"), lit("1.3.0"))) == "minor_upgrade"
    assert value(spark, version.change_class(lit("1.2.3"), lit("1.2.3-rc1"))) == "downgrade"


def test_purls_and_licences(spark):
    p = F.lit("pkg:npm/%40Scope/Name@1.0?x=y#z")
    assert value(spark, purl.purl_name(p)) == "Name" and value(spark, purl.purl_version(p)) == "1.0"
    assert value(spark, purl.purl_normal(p)) == "pkg:npm/@scope/name@1.0?x=y#z"
    assert value(spark, licence.licence_family(F.lit("MIT OR GPL-2.0"))) == "permissive"
    assert value(spark, licence.licence_family(F.lit("MIT AND GPL-2.0"))) == "copyleft"
    assert value(spark, licence.compatibility(F.lit("GPL-2.0-only"), F.lit("GPL-3.0-only"))) == 0
