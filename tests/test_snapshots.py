import random

from bomloom.operators.snapshots import snapshot_changes, with_values

DDL = "row_id bigint, snap_no int, loaded_at bigint, bom string, ref string, name string, version string, name_extra string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    c = snapshot_changes(df, "bom", "ref", "snap_no", "loaded_at", "row_id", ["name", "version"])
    found = with_values(c, df, "row_id", ["bom", "ref"]).collect()
    return sorted((r.bom, r.snap, r.ref or "", r.kind) for r in found)


def brute(rows):
    latest, snaps = {}, {}
    for row_id, snap, loaded, bom, ref, name, version, _ in rows:
        if bom is None or snap is None:
            continue
        snaps.setdefault(bom, set()).add(snap)
        key = (bom, snap, ref)
        rank = (loaded if loaded is not None else -(2**63), row_id)
        if key not in latest or rank > latest[key][0]:
            latest[key] = (rank, (name, version))
    out = []
    for bom, s in snaps.items():
        order = sorted(s)
        for prev, cur in zip(order, order[1:], strict=False):
            a = {k[2]: v[1] for k, v in latest.items() if k[:2] == (bom, prev)}
            b = {k[2]: v[1] for k, v in latest.items() if k[:2] == (bom, cur)}
            out += [(bom, cur, r or "", "added") for r in b.keys() - a.keys()]
            out += [(bom, cur, r or "", "removed") for r in a.keys() - b.keys()]
            out += [(bom, cur, r or "", "changed") for r in a.keys() & b.keys() if a[r] != b[r]]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(1500):
        rows.append((i, r.choice([1, 2, 3, 5, 9, None]), r.choice([1, 2, 2, None]), r.choice(["a", "a", "a", "b", "c", None]), r.choice([*"pqrstuv", None]), r.choice(["n", "m", None]), r.choice(["1", "2", None]), "x"))
    assert changes(spark, rows) == brute(rows)


def test_empty(spark):
    assert changes(spark, []) == []


def test_one_key_may_hold_most_rows(spark):
    rows = [(i, 1 + i % 2, i, "a", "hot", "n", str(i), None) for i in range(3000)]
    assert changes(spark, rows) == brute(rows) == [("a", 2, "hot", "changed")]


def test_values_and_buckets_at_any_size(spark):
    """Few and many changes, one and many buckets give the same rows."""
    rows = [(i, 1 + i % 3, i, f"b{i % 5}", f"r{i % 41}", "n", str(i % 7), None) for i in range(900)]
    df = spark.createDataFrame(rows, DDL)
    found = []
    for size, most in ((10_000, 10_000), (50, 3)):
        c = snapshot_changes(df, "bom", "ref", "snap_no", "loaded_at", "row_id", ["name", "version"], rows_per_bucket=size)
        found.append(sorted((r.bom, r.snap, r.ref, r.kind) for r in with_values(c, df, "row_id", ["bom", "ref"], most).collect()))
    assert found[0] == found[1] == brute(rows) and found[0]
