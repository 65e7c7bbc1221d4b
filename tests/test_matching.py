import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from bomloom.operators import matching
from bomloom.operators.matching import _hungarian

DDL = "sbom_id int, id string, name string, version string, ecosystem string, supplier string, licence string, purl string"


def test_hungarian_is_optimal():
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        s = np.array([[r.choice([0, 0, r.random()]) for _ in range(m)] for _ in range(n)])
        got = _hungarian(s)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        size = max(n, m)
        full = np.zeros((size, size))
        full[:n, :m] = np.where(s > 0, 1 + s, 0)
        best = max(sum(full[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
        assert abs(sum(1 + s[a, b] for a, b in got) - best) < 1e-9


def test_tiers_and_greedy(spark):
    old = spark.createDataFrame([(1, "o1", "react-dom", "1.0.0", "npm", None, None, "pkg:npm/react-dom@1.0.0"), (1, "o2", "Flask_Login", "2.0", "pypi", None, None, None), (1, "o3", None, None, None, None, None, None)], DDL)
    new = spark.createDataFrame([(2, "n1", "react-dom", "1.0.0", "npm", None, None, "pkg:npm/React-Dom@1.0.0"), (2, "n2", "flask-login", "2.1", "pypi", None, None, None), (2, "n3", "react-don", "1.0.1", "npm", None, None, None)], DDL)
    scored = matching.score_pairs(matching.candidates(old, new), old, new)
    tiers = {(r.old_id, r.new_id): (r.tier, r.score) for r in scored.collect()}
    assert tiers["o1", "n1"] == ("exact", 1.0) and tiers["o2", "n2"] == ("ecosystem_rule", 0.9) and tiers["o1", "n3"][0] == "fuzzy"
    assert {(r.old_id, r.new_id) for r in matching.greedy_assign(scored).collect()} == {("o1", "n1"), ("o2", "n2")}
    groups = old.select(F.col("id").alias("old_id"), F.lit("g").alias("grp"))
    assert {(r.old_id, r.new_id) for r in matching.assign(scored, groups).collect()} == {("o1", "n1"), ("o2", "n2")}
    assert matching.best_match(scored).count() == 2
    families = spark.createDataFrame([("http", "npm", "react-dom", 0.95), ("http", "pypi", "pydom", 0.95)], "family string, ecosystem string, name string, score double")
    assert [(r.id, r.name) for r in matching.equivalents(old, families).collect()] == [("o1", "pydom")]
