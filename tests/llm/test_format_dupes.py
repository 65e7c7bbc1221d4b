import random

import pytest
from pyspark.sql import functions as F

from bomloom.llm import format_dupes as fd

DDL = "comp_id bigint, bom_serial string, comp_type string, name string, version string, purl string, licenses array<struct<license: struct<id: string, name: string>, expression: string>>, properties array<struct<name: string, value: string>>, key string"
LIC = lambda *ids: [{"license": {"id": i, "name": None}, "expression": None} for i in ids]
PROP = lambda *kv: [{"name": k, "value": v} for k, v in kv]


def copies(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], DDL)
    return sorted(tuple(r) for r in fd.copies(df, "comp_id", fd.component_key()).collect())


def row(i, name="dagom-buffer2", version="1.9.5", purl="pkg:npm/%40a/dagom-buffer2@1.9.5?arch=x&distro=ember-3.1", licenses=None, properties=()):
    return (i, "urn:uuid:1-2", "library", name, version, purl, licenses, list(properties))


SAME = [
    row(1, licenses=LIC("MIT", "GPL-2.0"), properties=PROP(("a", "b c"), ("d", "e"))),
    row(2, name='"Dagom BUFFER2"', purl="<Pkg: npm/@A/Dagom.buffer2%401.9.5?distro=Ember-3.1&arch=X>", licenses=LIC("gpl-2.0", "mit"), properties=PROP(("D", "e"), ("a", "B-C"))),
]


def test_formatting_is_ignored(spark):
    assert copies(spark, SAME) == [(1, 2)]


@pytest.mark.parametrize(
    "other",
    [row(2, version="19.5"), row(2, version=None), row(2, purl=None), row(2, licenses=[]), row(2, licenses=LIC("MIT", "MIT")), row(2, name="dagom-buffer-2x"), row(2, properties=PROP(("a", "b"))), row(2, purl="pkg:npm/%40a/dagom-buffer2@1.9.5?arch=x&distro=ember-31")],
)
def test_content_is_not_ignored(spark, other):
    assert copies(spark, [row(1), other]) == []


def test_nulls_empty_texts_and_empty_table(spark):
    none = (None,) * 6
    assert copies(spark, [(5, *none, []), (3, *none, []), (4, "", None, None, None, None, None, []), (9, *none, None)]) == [(3, 5)]
    assert copies(spark, []) == []


def test_long_texts(spark):
    long = "Ab-" * 100_000
    assert copies(spark, [row(1, name=long), row(2, name=long.upper())]) == [(1, 2)]


def test_runs_over_partition_borders(spark):
    """A hot group of half of all rows is cut at partition borders and joined again."""
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < 0.5 else f"k{r.randrange(300)}") for i in r.sample(range(20_000), 4000)]
    df = spark.createDataFrame(rows, "id bigint, key string")
    first = {}
    for i, k in sorted(rows):
        first.setdefault(k, i)
    expected = sorted((first[k], i) for i, k in rows if first[k] != i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(tuple(x) for x in fd.copies(df, "id", F.col("key")).collect()) == expected
        counts = {r.keep_id: r.n_copies for r in fd.representatives(df, "id", F.col("key")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts == {i: sum(k == x for _, x in rows) for k, i in first.items()}


def test_oracle(compare):
    from bomloom.llm import queries

    assert compare(queries.QUERIES["p2_found"], queries.SQL["p2_found"]) > 0
