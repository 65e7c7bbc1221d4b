"""Wrapped documents and only elements outside their arrays are read like the plain ones."""

import json

import pytest

from bomloom import queries
from bomloom.functions.jsontext import parse
from bomloom.operators.shredding import unwrap
from bomloom.sources import documents
from tests.conftest import DATA

PACKAGE = {"SPDXID": "p", "name": "p", "versionInfo": "1", "externalRefs": {"referenceType": "purl", "referenceLocator": "pkg:npm/p@1"}}
STATEMENT = {"vulnerability": {"name": "V", "aliases": "W"}, "status": "fixed", "products": {"identifiers": {"purl": "pkg:npm/p@1"}}}


def test_plain_json(spark):
    bodies = [{"spdxVersion": "SPDX-2.3", "packages": PACKAGE}, {"sbom": {"packages": [PACKAGE]}}, {"statements": STATEMENT}, {"payload": {"statements": [STATEMENT]}}]
    docs = spark.createDataFrame([*((i, json.dumps(b)) for i, b in enumerate(bodies)), (4, "{broken"), (5, None)], "sbom_id long, text string")
    plain = documents.plain_json(docs)
    assert {(r.sbom_id, r.id) for r in documents.spdx_json(plain).components.collect()} == {(0, "pkg:npm/p@1"), (1, "pkg:npm/p@1")}
    assert {(r.sbom_id, r.vuln_id, r.status, r.purl) for r in documents.openvex(plain).collect()} == {(i, v, "fixed", "pkg:npm/p@1") for i in (2, 3) for v in "VW"}


@pytest.mark.parametrize(("name", "field"), [("src_spdx_packages", "packages"), ("src_openvex", "statements")])
def test_all_documents(spark, name, field):
    """Every document that holds an element with a name gives rows, the plain ones among them."""
    want = set()
    for r in spark.read.parquet(f"{DATA}/nested_docs.parquet").select("raw_id", "body").collect():
        held = (unwrap(parse(r.body), documents.MARKERS) or {}).get(field)
        for x in held if isinstance(held, list) else [held]:
            if isinstance(x, dict) and (x.get("name") if field == "packages" else isinstance(x.get("vulnerability"), dict) and x["vulnerability"].get("name")):
                want.add(r.raw_id)
    rows = queries.queries()[name](spark, DATA).collect()
    assert {r.sbom_id for r in rows} >= want
