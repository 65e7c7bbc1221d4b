"""Every value of a record is in a column or in ``other``."""

import json

from bomloom import queries
from bomloom.functions.jsontext import leaves, parse
from bomloom.operators.drift import unified_records
from bomloom.queries.general import DRIFT_COLUMNS
from tests.conftest import DATA


def test_nothing_is_lost(spark):
    doc = {"SPDXID": "s", "bom-ref": "b", "supplier": "A", "originator": "B", "size": "x", "weight": [1, 2], "tags": ["t", "u"]}
    df = spark.createDataFrame([(1, "f", 1, 1, json.dumps(doc))], "rec_no long, feed string, file_no long, line_no int, body string")
    columns = {"supplier": (["supplier", "originator"], "string"), "size": (["size"], "bigint"), "weight": (["weight"], "bigint"), "tags": (["tags"], "array<string>")}
    r = unified_records(df, columns).first()
    assert (r.record_id, r.supplier, r.size, r.weight, r.tags) == ("s", "A", None, 1, ["t", "u"])
    assert r.other == {"bom-ref": ["b"], "originator": ["B"], "size": ["x"], "weight": ["2"]}


def test_all_values_of_the_feeds(spark):
    rows = {r.rec_no: r.body for r in spark.read.parquet(f"{DATA}/drift_records.parquet").collect()}
    out = queries.queries()["p3_unified"](spark, DATA).collect()
    assert out and "originator" in out[0].asDict()
    for r in out:
        held = [r.record_id, *(x for c in DRIFT_COLUMNS for x in (r[c] if isinstance(r[c], list) else [r[c]])), *(x for v in json.loads(r.other).values() for x in v)]
        held = {str(x).lower() for x in held if x is not None}
        assert {text.lower() for _, _, text in leaves(parse(rows[r.rec_no]))} <= held
