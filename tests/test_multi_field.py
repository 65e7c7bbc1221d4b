import pytest
from pyspark.sql import functions as F

from bomloom.functions import text as tx
from bomloom.functions.version import version_divergence
from bomloom.model import Tables
from bomloom.operators import differ, matching
from bomloom.queries import oracle_sql, queries
from bomloom.queries.scalar import _DOCS

DATA = "/root/testdata/sf0.001"
SCHEMA = "sbom_id int, id string, name string, version string, ecosystem string, licence string, supplier string"
WEIGHTS = matching.FIELD_WEIGHTS["balanced"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two documents with versions that don't parse, missing fields and other letter case."""
    versions = ["1.2.3", "1.2.9", "v2.0", "2.0.0", "abc", "abd-1", "", None, "1.x", "3.1"]
    make = lambda doc, shift: [
        (doc, f"{doc}-{i}", ["left pad", "left-pad", "Left_Pads", "lefty"][i % 4], versions[(i + shift) % 10], ["npm", "NPM", "pypi", None][(i // 2) % 4], ["MIT", "mit", None][i % 3], ["Acme", "ACME", None, "Other"][(i // 3) % 4])
        for i in range(40)
    ]
    docs = spark.createDataFrame(make(1, 0) + make(2, 3), SCHEMA)
    side = lambda doc: docs.where(f"sbom_id = {doc}").drop("sbom_id").select(F.lit(1).alias("old_sbom"), F.lit(2).alias("new_sbom"), "*")
    return side(1), side(2)


def one_by_one(old, new):
    """The score spelled out for every candidate."""
    a, b = (d.select([F.col(c).alias(f"{x}_{c}") for c in d.columns if c not in _DOCS]) for d, x in ((old, "a"), (new, "b")))
    pairs = matching.candidates(old, new, by=_DOCS).join(a, F.col("old_id") == F.col("a_id")).join(b, F.col("new_id") == F.col("b_id"))
    agree = lambda c: F.when(F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull(), 0.5).when(F.lower(f"a_{c}") == F.lower(f"b_{c}"), 1.0).otherwise(0.0)
    total = tx.levenshtein_similarity(F.col("a_name"), F.col("b_name")) * 0.6 + version_divergence(F.col("a_version"), F.col("b_version")) * 0.1 + F.when(F.col("a_ecosystem") != F.col("b_ecosystem"), -0.15).otherwise(0.0)
    total = total + agree("ecosystem") * 0.15 + agree("licence") * 0.08 + agree("supplier") * 0.04
    return sorted((r.old_id, r.new_id, r.score) for r in pairs.select("old_id", "new_id", F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 6).alias("score")).collect())


def test_scores_of_odd_fields(odd):
    got = sorted((r.old_id, r.new_id, r.score) for r in matching.multi_field_scores(*odd, WEIGHTS, _DOCS).collect())
    assert got == one_by_one(*odd) and len(got) > 500


def test_pairs_are_not_joined_again(spark):
    """A pair of components is made once, with its fields: it is no key of a join."""
    plan = queries()["er_multifield"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join [" in x and ("old_id" in x.split("]")[0] or "new_id" in x.split("]")[0])]


def test_without_twins(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (4, "a"), (4, "c"), (4, "d")]
    c = spark.createDataFrame(rows, "sbom_id int, id string")
    t = Tables(c, c, c)
    pairs = differ.consecutive_pairs(t)
    want = differ.unmatched(t, pairs, differ.identity_matches(t, pairs))
    for got, of in zip(differ.without_twins(t, pairs), want, strict=True):
        assert got.columns == of.columns and sorted(got.collect()) == sorted(of.collect())


def no_pairs(df):
    """Whether the plan never holds pairs of ids."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "old_id" not in plan and "new_id" not in plan


def test_counts_and_ratio(spark, odd):
    counts = matching.multi_field_counts(*odd, WEIGHTS, _DOCS)
    rows = matching.multi_field_scores(*odd, WEIGHTS, _DOCS)
    assert {r.score: r.n for r in counts.collect()} == {r.score: r["count"] for r in rows.groupBy("score").count().collect()}
    for ratio in (0.1, 0.25, 0.5, 0.9):
        want = rows.agg(F.expr(f"percentile_disc({1 - ratio!r}) within group (order by score)")).head()[0]
        assert matching.ratio_threshold(counts, ratio).head()[0] == want


def test_ratio_threshold_lists_no_pairs(spark, compare):
    assert no_pairs(queries()["er_ratio_threshold"](spark, DATA))
    compare(queries()["er_ratio_threshold"], oracle_sql()["er_ratio_threshold"])


def test_statistics_of_counts(spark, odd):
    counts = matching.multi_field_counts(*odd, WEIGHTS, _DOCS)
    s = F.col("score")
    want = matching.multi_field_scores(*odd, WEIGHTS, _DOCS).agg(F.count("*"), F.min(s), F.max(s), F.avg(s), F.stddev_pop(s), F.percentile(s, F.lit(0.5)), F.count_if(s >= 0.9999), F.count_if(s <= 0.0)).head()
    assert list(matching.score_statistics(counts).head()) == pytest.approx(list(want), abs=1e-12)
    assert list(matching.score_statistics(counts.where("false")).head()) == [0, None, None, None, None, None, 0, 0]


def test_statistics_list_no_pairs(spark, compare):
    assert no_pairs(queries()["er_statistics"](spark, DATA))
    compare(queries()["er_statistics"], oracle_sql()["er_statistics"])
