import json

from bomloom.operators.drift import file_schemas, parsed_records, schema_changes, schema_versions, unified_records, version_steps

DDL = "rec_no bigint, feed string, file_no bigint, line_no int, body string, feed_extra string"


def frame(spark, files):
    rows, n = [], 0
    for feed, no, docs in files:
        for line, d in enumerate(docs):
            n += 1
            rows.append((n, feed, no, line, d if isinstance(d, (str, type(None))) else json.dumps(d), "x"))
    return spark.createDataFrame(rows, DDL)


def changes(spark, files):
    return sorted((r.feed, r.file_no, r.change_kind, r.field_path, r.new_path) for r in schema_changes(frame(spark, files)).collect())


A = [{"SPDXID": f"s{i}", "name": f"n{i}", "version": f"1.{i}", "licenses": [{"license": {"id": f"L{i}"}}], "size": i} for i in range(4)]


def renamed(d, old, new, value=None):
    d = dict(d)
    v = d.pop(old)
    d[new] = value(v) if value else v
    return d


def test_kinds(spark):
    b = [renamed(d, "version", "release", lambda v: {"number": v}) for d in A]
    c = [{**d, "size": str(d["size"]), "extra": True} for d in b]
    e = [{k: v for k, v in d.items() if k != "extra"} for d in c]
    assert changes(spark, [("f", 1, A), ("f", 2, b), ("f", 3, c), ("f", 4, e)]) == [
        ("f", 2, "renamed", "version", "release.number"), ("f", 3, "added", "extra", ""), ("f", 3, "retyped", "size", ""), ("f", 4, "removed", "extra", ""),
    ]


def test_dirt_is_no_change(spark):
    broken = [*A, '{"SPDXID": "s9", "zzz', None, "[1, NaN]"]
    nulls = [{**A[0], "version": None}, *A[1:]]
    assert changes(spark, [("f", 1, A), ("f", 2, broken), ("f", 3, nulls + nulls), ("g", 7, A)]) == []


def test_values_that_differ_are_no_rename(spark):
    b = [renamed(d, "version", "other", lambda v: v + "x") for d in A]
    assert changes(spark, [("f", 1, A), ("f", 2, b)]) == [("f", 2, "added", "other", ""), ("f", 2, "removed", "version", "")]


def test_one_changed_value_still_renames(spark):
    b = [renamed(d, "version", "ver") for d in A]
    b[0]["ver"] = "9.9"
    assert ("f", 2, "renamed", "version", "ver") in changes(spark, [("f", 1, A), ("f", 2, b)])


def test_empty(spark):
    assert changes(spark, []) == []


def test_unified_routes_through_chained_renames(spark):
    b = [renamed(d, "version", "ver") for d in A]
    c = [renamed(d, "ver", "release") for d in b]
    df = frame(spark, [("f", 1, A), ("f", 2, b), ("f", 3, c)])
    out = unified_records(df, {"version": (["release"], "string"), "size": (["size"], "bigint"), "licences": (["licenses.license.id"], "array<string>"), "scope": (["scope"], "string")}, defaults={"scope": "required"}).collect()
    assert len(out) == 12
    assert {(r.file_no, r.record_id, r.version) for r in out} == {(n, f"s{i}", f"1.{i}") for n in (1, 2, 3) for i in range(4)}
    assert all(r.scope == "required" and r.licences == [f"L{r.size}"] for r in out)
    versions = schema_versions(file_schemas(parsed_records(df)))
    assert [(r.before, r.version) for r in versions.orderBy("file_no").collect()] == [(None, 1), (1, 2), (2, 3)]


def test_a_column_follows_its_chain(spark):
    """No list names the later names of a field: its chain leads to the column, also for another feed's own names."""
    b = [renamed(d, "version", "never_listed") for d in A]
    c = [renamed(renamed(d, "never_listed", "nor_this"), "size", "bytes", str) for d in b]
    c[0]["bytes"] = "many"
    df = frame(spark, [("f", 1, A), ("f", 2, b), ("f", 5, c), ("g", 1, A)])
    out = unified_records(df, {"version": (["version"], "string"), "size": (["size"], "bigint")}).collect()
    assert {(r.feed, r.file_no, r.record_id, r.version) for r in out} == {(f, n, f"s{i}", f"1.{i}") for f, n in (("f", 1), ("f", 2), ("f", 5), ("g", 1)) for i in range(4)}
    assert [(r.record_id, r.size, r.cast_failed, r.other["bytes"]) for r in out if r.cast_failed] == [("s0", None, ["size"], ["many"])]
    assert sorted(r.size for r in out if r.size is not None) == sorted([0, 1, 2, 3] * 3 + [1, 2, 3])


def test_steps_by_version(spark):
    b = [renamed(d, "size", "bytes", str) for d in A]
    steps = {(r.feed, r.version, r.file_no, r.step, r.field_path, r.new_path, r.old_types, r.new_types) for r in version_steps(frame(spark, [("f", 1, A), ("f", 2, A), ("f", 3, b), ("f", 4, [{**d, "x": True} for d in b])])).collect()}
    assert steps == {("f", 1, 1, "first", "", "", "", ""), ("f", 2, 3, "rename", "size", "bytes", "number", "string"), ("f", 3, 4, "default", "x", "", "", "boolean")}
