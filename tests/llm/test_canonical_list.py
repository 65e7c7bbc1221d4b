import random

import pytest
from pyspark.sql import functions as F

from bomloom.llm import canonical_list as cl
from bomloom.operators.set_join import letter_tokens, similarity_join

LIST = [
    ("Harrow-PL-2.0-only", "Harrow Public License v2.0 only"), ("Harrow-PL-2.0-or-later", "Harrow Public License v2.0 or later"), ("Harrow-LPL-2.1-only", "Harrow Lesser Public License v2.1 only"),
    ("Quern-1.0", "Quern License v1.0"), ("Quern-2.0", "Quern License v2.0"), ("Ombre-PAT-1.0", "Ombre Patent License v1.0"), ("Castel-2C-1.0", "Castel Two Clause License v1.0"),
]
CASES = [
    ("harrow public licence (2)+", "Harrow-PL-2.0-or-later"), ("Publ Lic., Harrow: ver. 2, this version only", "Harrow-PL-2.0-only"), ("HarrowPLv2.0 or newer", "Harrow-PL-2.0-or-later"), ("Harrwo_PL_2.0_only", "Harrow-PL-2.0-only"),
    ("Harrow Public License v2.0", cl.UNMATCHED), ("Harrow Public License", cl.UNMATCHED), ("Harrow Lesser Public License 3 only", cl.UNMATCHED), ("Quern License, version 2", "Quern-2.0"), ("the Quern licencia", cl.UNMATCHED),
    (" https://x.example/castel-2c-1.0.html.", "Castel-2C-1.0"), ("Castel2C1.0", "Castel-2C-1.0"), ("The Ombre Patent Lizenz", "Ombre-PAT-1.0"), ("proprietary", cl.UNMATCHED), ("", cl.UNMATCHED), (None, cl.UNMATCHED), ("?", cl.UNMATCHED), ("x" * 20000, cl.UNMATCHED),
]


@pytest.fixture(scope="module")
def mapped(spark):
    values = spark.createDataFrame([(i, v, "clash") for i, (v, _) in enumerate(CASES + CASES[:1])], "n int, value string, name string")
    entries = spark.createDataFrame(LIST, "license_id string, name string")
    return {r.n: r.license_id for r in cl.map_to_list(values, "value", entries).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_values(mapped, n):
    assert mapped[n] == CASES[n][1]


def test_repeated_rows_stay(mapped):
    assert len(mapped) == len(CASES) + 1


def test_empty_tables(spark):
    entries = spark.createDataFrame(LIST, "license_id string, name string")
    assert cl.map_to_list(spark.createDataFrame([], "value string"), "value", entries).count() == 0
    values = spark.createDataFrame([("Quern-1.0",)], "value string")
    assert cl.map_to_list(values, "value", entries.limit(0)).first().license_id == cl.UNMATCHED


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_set_join_against_brute_force(spark, t):
    r = random.Random(2)
    sets = lambda n: [(f"{n}{i}", sorted({r.choice("abcdefghijklm") for _ in range(r.randrange(0, 9))})) for i in range(60)]
    a, b = sets("a"), sets("b")
    ddl = "id string, tokens array<string>"
    got = {(x.left_id, x.right_id): round(x.jaccard, 6) for x in similarity_join(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), t).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            if x and y:
                s = len(set(x) & set(y)) / len(set(x) | set(y))
                if s >= t:
                    want[i, j] = round(s, 6)
    assert got == want


def test_letter_tokens(spark):
    got = spark.range(1).select(letter_tokens(F.lit("aab")).alias("t")).first().t
    assert got == ["^a", "aa", "ab", "b$", "a#0", "a#1", "b#0"]
