import random

from bomloom.operators.set_join import similar_sets


def test_similar_sets_against_brute_force(spark):
    r = random.Random(5)
    sets = {i: {f"t{r.randrange(25)}" for _ in range(r.randrange(0, 14))} for i in range(60)} | {90: {"t1", "t2", "t3"}, 91: {"t1", "t2", "t3"}}
    rows = [(i, t, "clash") for i, s in sets.items() for t in s] + [(90, "t1", "again"), (None, "t1", "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "set_id int, token string, n string")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= threshold - 1e-9}
        got = {(q.a, q.b): q.jaccard for q in similar_sets(df, threshold).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert similar_sets(df.limit(0), 0.5).count() == 0
