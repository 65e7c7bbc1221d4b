"""Matching runs over whole documents and all consecutive pairs."""

import pytest

from bomloom import queries, testdata
from bomloom.model import Tables
from bomloom.operators import differ, matching
from tests.conftest import DATA


DOCS = ("old_sbom", "new_sbom")


@pytest.fixture(scope="module")
def sides(spark):
    """The whole documents of all consecutive pairs."""
    c = testdata.components(spark, DATA).cache()
    pairs = differ.consecutive_pairs(Tables(c, c, c)).cache()
    return tuple(c.join(pairs, c.sbom_id == pairs[d]).cache() for d in DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    """Each year's components at this scale, and the scores of every old with every new one by ``score_pairs``."""
    c = testdata.components(spark, DATA).cache()
    years = sorted(r.sbom_id for r in c.select("sbom_id").distinct().collect())
    scored = {}
    for old, new in zip(years, years[1:], strict=False):
        a, b = c.where(f"sbom_id = {old}"), c.where(f"sbom_id = {new}")
        keys = [{}, {}]
        for held, side in zip(keys, (a, b), strict=True):
            for r in matching.blocks(side).collect():
                held.setdefault(r.id, set()).add(r.key)
        names = [{r.id: r.name for r in side.collect()} for side in (a, b)]
        pairs = [(o, n) for o, ko in keys[0].items() for n, kn in keys[1].items() if ko & kn and abs(len(names[0][o]) - len(names[1][n])) <= 10]
        got = matching.score_pairs(spark.createDataFrame(pairs, "old_id string, new_id string"), a, b).collect()
        scored[old, new] = {(r.old_id, r.new_id): (round(r.score, 9), r.tier) for r in got}
    return scored


def test_scores(sides, documents):
    got = {}
    for r in matching.all_scores(*sides, by=DOCS).collect():
        assert got.setdefault((r.old_sbom, r.new_sbom), {}).setdefault((r.old_id, r.new_id), (round(r.score, 9), r.tier)) == (round(r.score, 9), r.tier)
    assert got == documents


def test_candidates(sides, documents):
    got = [tuple(r) for r in matching.candidates(*sides, by=DOCS).collect()]
    assert sorted(got) == sorted((*d, *p) for d, pairs in documents.items() for p in pairs)


def test_greedy(sides, documents):
    want = set()
    for d, pairs in documents.items():
        olds, news = set(), set()
        for (o, n), (s, _) in sorted(pairs.items(), key=lambda x: (-x[1][0], x[0])):
            if s > 0 and o not in olds and n not in news:
                olds.add(o)
                news.add(n)
                want.add((*d, o, n))
    alike = tuple(matching.alike(d, DOCS) for d in sides)
    got = [(r.old_sbom, r.new_sbom, r.old_id, r.new_id) for r in matching.greedy_assign(matching.alike_scores(*alike, by=DOCS), DOCS, alike).collect()]
    assert len(got) == len(want) and set(got) == want


def test_queries_score_what_identity_leaves(spark, sides, documents):
    ids = [{(r.old_sbom, r.id) for r in d.collect()} for d in sides]
    want = {(*d, o, n): (round(s[0], 6), s[1]) for d, pairs in documents.items() for (o, n), s in pairs.items() if (d[0], o) not in ids[1] and (d[0], n) not in ids[0]}
    got = {(r.old_sbom, r.new_sbom, r.old_id, r.new_id): (r.score, r.tier) for r in queries.queries()["er_scores"](spark, DATA).collect()}
    assert got == want and got


def test_full_matches_drive_the_diff(spark):
    """A renamed component is one modification, not a removal and an addition."""
    ddl = "sbom_id int, id string, name string, version string, ecosystem string, supplier string, licence string, purl string, hash string"
    rows = [(1, "a", "left-pad", "1.0.0", "npm", None, "MIT", None, None), (2, "b", "left_pad", "1.0.1", "npm", None, "MIT", None, None), (1, "c", "zlib", "1.2", "generic", None, None, None, None), (2, "c", "zlib", "1.3", "generic", None, None, None, None), (2, "d", "unrelated", "9", "npm", None, None, None, None)]
    c = spark.createDataFrame(rows, ddl)
    t = Tables(c, c, c)
    pairs = differ.consecutive_pairs(t)
    kinds = lambda m: sorted((r.kind, r.id) for r in differ.component_changes(t, pairs, m).collect())
    assert kinds(differ.identity_matches(t, pairs)) == [("added", "b"), ("added", "d"), ("modified", "c"), ("removed", "a")]
    assert kinds(differ.full_matches(t, pairs)) == [("added", "d"), ("modified", "b"), ("modified", "c")]
