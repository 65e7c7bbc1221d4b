import pytest

from bomloom.llm import entity_match as em

DDL = "rec_id bigint, src int, name string, version string, supplier string, eco string, space string, purl string, day int, words string"


def matches(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], DDL)
    return {(r.rec_id_a, r.rec_id_b) for r in em.match_releases(df).where("confidence >= 0.5").collect()}


def inv(i, name, version, supplier=None, eco=None, day=None):
    return (i, 0, name, version, supplier, eco, None, None, day)


def spdx(i, name, version, supplier=None, eco=None, space=None, day=None):
    return (i, 1, name, version, supplier, eco, space, None, day)


def vuln(i, purl, supplier=None, day=None):
    return (i, 2, None, None, supplier, None, None, purl, day)


@pytest.mark.parametrize(("text", "version"), [("v2.10.0", "2.10"), ("2:6.5.11-4", "6.5.11"), ("release-2.0.1", "2.0.1"), ("4_8_0", "4.8"), ("5.3.0 (stable)", "5.3"), ("1.2.3+build.9", "1.2.3"), ("1.2.3-rc1", "1.2.3-rc1"), ("latest", None), ("", None), (None, None)])
def test_versions(text, version):
    assert em.version_of(text) == version


def test_names():
    d = em.name_distance
    assert d(["vuzum", "clock"], ["clock", "vuzum"], None, None) == 0 and d(["vuzumclock"], ["vuzum", "clock"], None, None) == 0
    assert d(["vzuum", "clock"], ["vuzum", "clock"], None, None) == 1 and d(["zadil", "gw"], ["zadil", "gateway"], None, None) == 1
    assert d(["vuzum", "clock"], ["vuzum", "clock", "lite"], None, None) is None and d(["vuzum", "vault"], ["vuzum", "vault4"], None, None) is None
    assert d(["klaxam", "vuzum", "clock"], ["vuzum", "clock"], None, "klaxam") == 0


def test_written_freely(spark):
    rows = [
        inv(1, "Vuzum.Clock", "v2.5.1", "Klaxam Systems Ltd", "maven", 100), spdx(2, "clock, vuzum", "2:2.5.1-4", "klaxam-systems.example", "maven", "klaxam", 102), vuln(3, "pkg:deb/klaxam/libvuzum-clock-java@2.5.1.Final?arch=x"),
        inv(4, "vuzum-clock-lite", "2.5.1", "Klaxam Systems", "maven", 100), inv(5, "vuzum-clock", "2.5.2", "Klaxam Systems", "maven"), inv(6, None, "2.5.1"), inv(7, "", ""), vuln(8, "no purl"),
    ]
    assert matches(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_namesakes_are_told_apart(spark):
    rows = [inv(1, "tus-archive", "1.7.0", "Vobu Networks", "maven", 10), inv(2, "tus-archive", "1.7.0", "Fuvim Data", "golang", 500), spdx(3, "tus-archive", "1.7.0", "Vobu Networks"), spdx(4, "tus-archive", "1.7.0", None, "golang"), vuln(5, "pkg:generic/tus-archive@1.7.0", None, 501)]
    assert matches(spark, rows) == {(1, 3), (2, 4), (2, 5), (4, 5)}


def test_listed_twice_and_single_release(spark):
    rows = [inv(1, "por-batch", "1.0.0", "Nade Labs", "npm"), inv(2, "pór-batch", "1.0", "Nade Labs", "npm"), spdx(3, "por-batch", None, "Nade Labs", "npm", "nade"), vuln(4, "pkg:npm/%40nade/por-batch@latest")]
    assert matches(spark, rows) == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    assert matches(spark, [*rows, inv(9, "por-batch", "2.0.0", "Nade Labs", "npm")]) == set()


def test_equal_rows_and_empty_table(spark):
    rows = [inv(i, "por-batch", "1.0.0", "Nade Labs", "npm") for i in range(30)] + [spdx(99, "por-batch", "1.0.0", "Nade Labs", "npm", "nade")]
    assert matches(spark, rows) == {(i, 99) for i in range(30)}
    assert matches(spark, []) == set()


def test_rivals_overrule_the_prior(spark):
    """A planted namesake whose own evidence is for a match: only the one-to-one factor tells that it is none."""
    rows = [inv(1, "tus-archve", "1.7.0", "Vobu Networks", None, 10), spdx(3, "tus-archive", "1.7.0", "Vobu Networks", "maven", None, 11), spdx(4, "tus-archive", "1.7.0", None, "golang", None, 12)]
    edges, _ = em.release_graph(spark.createDataFrame([(*r, "clash") for r in rows], DDL))
    beliefs = {(r.a, r.b): (r.prior, r.confidence) for r in em.one_to_one_beliefs(edges).collect()}
    assert beliefs[1, 3][1] > 0.8 and beliefs[1, 4][0] > 0 and beliefs[1, 4][1] < 0.5


def test_estimated_weights():
    """Evidence that agrees among most pairs and differs among the others is found without labels, and stays bounded."""
    patterns = [(0, 0, 0, 0, -1, 900), (1, 0, -1, 0, -1, 200), (0, 1, 1, 1, -1, 150), (0, -1, -1, 1, 1, 30)]
    base, weights = em.estimate(patterns)
    assert 1 < base < 3 and all(abs(x) <= em.BOUND for w in weights.values() for x in w)
    assert all(weights[f][0] > 1 > -1 > weights[f][1] for f in ("supplier", "eco", "day"))
    assert em.estimate([])[0] == 0.0
