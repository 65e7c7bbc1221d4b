import json

from bomloom.operators.shredding import ROOT, analyse, flat_table, leaf_values, shred
from bomloom.queries.general import DOC_MARKERS

LEAVES = {
    "external_ref": ("packages", "externalRefs", "referenceLocator"), "checksum": ("packages", "checksums", "checksumValue"), "product": ("statements", "products", "identifiers", "purl"),
}


def frame(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, (str, type(None))) else json.dumps(d), "x") for i, d in enumerate(docs)], "raw_id bigint, body string, doc_id string")


def found(spark, docs):
    return sorted(tuple(r) for r in leaf_values(frame(spark, docs), "raw_id", "body", LEAVES, DOC_MARKERS).collect())


PKG = {"packages": [{"externalRefs": [{"referenceLocator": "a"}, None, {"referenceLocator": "b"}], "hasFiles": [{"checksums": [{"checksumValue": "no"}]}], "checksums": {"checksumValue": "c"}}]}
VEX = {"statements": [{"products": [{"identifiers": {"purl": "p"}, "subcomponents": [{"identifiers": {"purl": "no"}}]}, {"identifiers": None}]}, {"products": {"identifiers": {"purl": "q"}}}]}


def test_positions_objects_nulls_and_decoys(spark):
    assert found(spark, [PKG, VEX]) == [(0, "checksum", 0, 0, "c"), (0, "external_ref", 0, 0, "a"), (0, "external_ref", 0, 2, "b"), (1, "product", 0, 0, "p"), (1, "product", 1, 0, "q")]


def test_wrapped_broken_and_empty(spark):
    docs = [{"payload": PKG, "receivedFrom": "x"}, json.dumps(PKG)[:-5], None, "", "[]", {"packages": [{"checksums": [{"checksumValue": ""}, {"checksumValue": None}]}]}]
    assert found(spark, docs) == [(0, "checksum", 0, 0, "c"), (0, "external_ref", 0, 0, "a"), (0, "external_ref", 0, 2, "b")]


def test_singletons_are_inlined_when_not_shared(spark):
    assert found(spark, [{"statements": [{"products": [{"identifiers": {"purl": "p"}}]}]}]) == [(0, "product", 0, 0, "p")]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_tables_link_children_to_parents(spark):
    docs = frame(spark, [{"packages": [{"name": "n", "info": {"deep": {"x": 1}}, "checksums": [{"checksumValue": "c"}], "tags": ["t", "u"]}, {"name": "m", "children": [{"name": "k", "children": [{"name": "z"}]}]}]}])
    plan = analyse(docs, "body", DOC_MARKERS)
    assert plan.tables == {ROOT, "packages", "checksums", "tags", "children"}
    rows = shred(docs, "raw_id", "body", plan, DOC_MARKERS)
    packages = flat_table(rows, "packages", ["name", "info.deep.x"]).orderBy("pos").collect()
    assert [(r.name, r.info_deep_x, r.pos) for r in packages] == [("n", "1", 0), ("m", None, 1)]
    tags = flat_table(rows, "tags", [""]).orderBy("pos").collect()
    assert [(t.value, t.pos, t.parent_no) for t in tags] == [("t", 0, packages[0].node_no), ("u", 1, packages[0].node_no)]
    kids = {r.name: r for r in flat_table(rows, "children", ["name"]).collect()}
    assert kids["z"].parent_no == kids["k"].node_no and kids["k"].parent_table == "packages"


def test_maps_keyed_by_data_are_folded(spark):
    """Keys that are data make one repeated element, at the root's children and inside one another."""
    import json

    from bomloom.operators.shredding import analyse, shred

    docs = [{"packages": [{"name": "p"}], "files": {f"sha{i}-{j}": {"size": j, "tags": {f"t{i}{j}{k}": k for k in range(3)}} for j in range(4)}} for i in range(6)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "raw_id bigint, body string")
    plan = analyse(df, "body", most_fields=10)
    assert plan.maps == {"files", "tags"} and {"files.*", "tags.*", "packages"} <= plan.tables
    assert sum(len(c) for c in plan.children.values()) < 10
    rows = shred(df, "raw_id", "body", plan).collect()
    files = [r for r in rows if r.table_name == "files.*"]
    assert {(r.doc_id, r.cols["*key"], r.cols["size"]) for r in files} == {(i, f"sha{i}-{j}", str(j)) for i in range(6) for j in range(4)}
    at = {(r.doc_id, r.node_no): r for r in rows}
    tags = [r for r in rows if r.table_name == "tags.*"]
    assert {(at[r.doc_id, r.parent_no].cols["*key"], r.cols["*key"], r.cols[""]) for r in tags} == {(f"sha{i}-{j}", f"t{i}{j}{k}", str(k)) for i in range(6) for j in range(4) for k in range(3)}
