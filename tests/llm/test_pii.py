import importlib.util
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from bomloom.llm import pii, pii_spans, pii_train
from bomloom.llm.boosting import Boosted, best_threshold
from bomloom.llm.pii_spans import KINDS

_spec = importlib.util.spec_from_file_location("held_out", Path(__file__).with_name("held_out.py"))
held_out = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(held_out)


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500], x[1500:], y[1500:])
    p = m.probability(x[1500:])
    assert ((p > best_threshold(p, y[1500:])) == y[1500:]).mean() > 0.97


@pytest.fixture(scope="module")
def models():
    return pii.fitted()


def _shares(models, docs):
    places = {(i, pii.KINDS[k], a, b) for i, a, b, k in pii.judge(pii.prepared([t for t, _ in docs]), models)}
    true = {(i, k, a, b) for i, (_, marked) in enumerate(docs) for k, a, b in marked}
    for k in KINDS:
        found, real = {x for x in places if x[1] == k}, {x for x in true if x[1] == k}
        yield k, len(found & real) / len(found), len(found & real) / len(real)


def test_held_out_sentences(models):
    """Other sentences than the forests were fitted on, other names and numbers."""
    mine = {t for group in pii_train.Maker.POSITIVE.values() for t in group} | set(pii_train.Maker.NEGATIVE)
    other = {t for group in held_out.POSITIVE.values() for t in group} | set(held_out.NEGATIVE)
    assert not mine & other
    for kind, precision, recall in _shares(models, pii_train.sample(1500, 321, held_out.POSITIVE, held_out.NEGATIVE)):
        assert precision > 0.95 and recall > 0.9, (kind, precision, recall)


def test_rare_words_keep_their_evidence():
    """A word counts by its other sightings, be the corpus small or large."""
    few = ["Ms Ada Quennerby called.", "We think Ada Quennerby is right."]
    many = few + [f"Mr Tom Fenwick wrote {i} lines." for i in range(300)]
    small, large = (pii.prepared(t) for t in (few, many))
    rows = [x.x[0][x.row[x.at[0]] == 1][:, -2:].tolist() for x in (small, large)]
    assert rows[0] == rows[1] and rows[0] and max(map(max, rows[0])) > 0


def test_long_words_are_read_whole():
    local, label = "a" * 300, "passport " + "of the very same person " * 3
    boxes = [s for s in pii_spans.spans(f"mail {local}@x.example now")[0] if s.kind == 1]
    assert [(s.start, s.end) for s in boxes] == [(5, 5 + 300 + 10)]
    number = [s for s in pii_spans.spans(f"{label} 12345678X")[0] if s.kind == 3]
    assert number and all(s.features[0] for s in number)


CASES = [
    ("Phone +44 (0)20 7946 0914 and ask for Norvessen, Emre.", [("phone", "+44 (0)20 7946 0914"), ("person", "Norvessen, Emre")]),
    ("Ticket 000-23-7608 was closed as a duplicate of 000-23-7608.", []),
    ("Clone it from git@forge.a.example:a/b.git; uses core@latest and b@1.2.3", []),
    ("mailto:kenji.quenquist (at) corp (dot) zurk (dot) example", [("email", "kenji.quenquist (at) corp (dot) zurk (dot) example")]),
    ("Someone pasted passport 06566890H into the ticket.", [("id_number", "06566890H")]),
    ("Postal address: 87 Kiln Road #20,\nLowbridge QX5 4ZB\nThe cache", [("address", "87 Kiln Road #20,\nLowbridge QX5 4ZB")]),
    ("Checksum prefix 4547 6196 2987 is wrong on 2031-10-08.", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(models, text, want):
    got = [(KINDS[k], text[a:b]) for _, a, b, k in pii.judge(pii.prepared([text]), models)]
    assert got == want


def test_tables(spark):
    long = "nothing here " * 50_000 + "Phone +44 (0)20 7946 0914 now"
    rows = [(1, CASES[0][0], "x"), (1, CASES[0][0], "x"), (2, None, "x"), (3, "", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pii_kind string")
    found = Counter((r.doc_id, r.pii_kind) for r in pii.find_pii(df).collect())
    assert found == {(1, "phone"): 2, (1, "person"): 2, (4, "phone"): 1}
    clean = {(r.doc_id, r.text if r.doc_id < 4 else r.text[-20:]) for r in pii.redact(df).collect()}
    assert clean == {(1, "Phone [PHONE] and ask for [PERSON]."), (2, None), (3, ""), (4, "re Phone [PHONE] now")}
    assert pii.find_pii(df.limit(0)).count() == 0
