"""Exact assignment: classes with several units against the dense method, and groups of any size."""

import random

import numpy as np
import pandas as pd

from bomloom.operators.matching import _hungarian, _optimal, assign


def _check(r, classes_old, classes_new, most, scores):
    olds = {f"o{i:03}": [f"o{i:03}.{k}" for k in range(r.randint(1, most))] for i in range(classes_old)}
    news = {f"n{i:03}": [f"n{i:03}.{k}" for k in range(r.randint(1, most))] for i in range(classes_new)}
    edges = [(o, n, r.choice(scores)) for o in olds for n in news if r.random() < 0.5]
    olds, news = {o: x for o, x in olds.items() if any(e[0] == o for e in edges)}, {n: x for n, x in news.items() if any(e[1] == n for e in edges)}
    if not edges:
        return
    got = _optimal(pd.DataFrame(edges, columns=["old_id", "new_id", "score"]), olds, news)
    given = {(a, b): s for o, n, s in edges for a in olds[o] for b in news[n]}
    assert all(given[a, b] == s for a, b, s in got)
    assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
    rows, cols = sorted({a for a, _ in given}), sorted({b for _, b in given})
    dense = np.array([[given.get((a, b), 0) for b in cols] for a in rows])
    want = sum(1 + dense[i, j] for i, j in _hungarian(dense))
    assert abs(sum(1 + s for _, _, s in got) - want) < 1e-6


def test_transport_is_optimal():
    r = random.Random(5)
    for _ in range(300):
        _check(r, r.randint(1, 7), r.randint(1, 7), r.randint(1, 4), [0.85, 0.9, 0.92, 1.0, r.random() + 0.01])
    _check(r, 60, 60, 4, [0.85, 0.87, 0.9, 0.97, 1.0])


def test_large_groups_are_solved_exactly(spark):
    """2,100 ids on a side: by score alone o-0 takes n-1's only partner, and a pair is lost each time."""
    rows = [x for i in range(1050) for x in ((f"a{i}", f"x{i}", 1.0), (f"a{i}", f"y{i}", 0.9), (f"b{i}", f"x{i}", 0.95))]
    scored = spark.createDataFrame(rows, "old_id string, new_id string, score double")
    one = spark.createDataFrame([(o, "g") for o in sorted({r[0] for r in rows})], "old_id string, grp string")
    want = {(f"a{i}", f"y{i}") for i in range(1050)} | {(f"b{i}", f"x{i}") for i in range(1050)}
    assert {(r.old_id, r.new_id) for r in assign(scored, one).collect()} == want
    assert {(r.old_id, r.new_id) for r in assign(scored).collect()} == want
