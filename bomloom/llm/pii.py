"""Personal data in free text: candidate gradient boosting.

Generators with high recall propose overlapping spans (``pii_spans``).  Boosted
trees, one forest for each kind, judge them by format, context and what all
other texts of the corpus say about their words; Platt-calibrated probabilities
and thresholds from held-out texts select the redactions, the likeliest first.
The trees are fitted on invented labelled texts of a fixed size (``pii_train``).

Every text is read once: its spans and the words they refer to are written to
the shared folder, the words' sightings are summed over the corpus and joined
back, and the spans are judged in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomloom.llm.boosting import Boosted, best_threshold
from bomloom.llm.pii_spans import KINDS, OWN_FEATURES, WORD_FEATURES, spans
from bomloom.llm.pii_train import sample
from bomloom.runtime import materialize

PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
#: Bound on the labelled sample, in texts; a third of them is held out.
TRAINING_TEXTS = 4500

#: Features of a name that are a sign by themselves: cues before and behind, signatures, mailboxes, "by", labels.
SIGNS = [0, 1, 3, 4, 18, 19]

_WORDS = [("h", pa.int64()), ("seen", pa.int32()), ("plain", pa.int32())]
_SPANS = [("kinds", pa.int8()), ("starts", pa.int32()), ("ends", pa.int32()), ("groups", pa.int32()), ("refs", pa.int32()), ("feats", pa.float32())]
_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), *((n, pa.list_(t)) for n, t in [*_SPANS, *_WORDS])])
_CANDIDATES_DDL = (
    "doc_id bigint, mark bigint, kinds array<tinyint>, starts array<int>, ends array<int>, groups array<int>, refs array<int>, feats array<float>, h array<bigint>, seen array<int>, plain array<int>"
)


def encode(text: str) -> dict[str, list]:
    """A text's spans and its words as flat lists; a span's two references count the words from 0, -1 is none."""
    found, words = spans(text)
    at = {w: i for i, w in enumerate(words)}
    at[None] = -1
    out: dict[str, list] = {n: [] for n, _ in [*_SPANS, *_WORDS]}
    for s in found:
        out["kinds"].append(s.kind)
        out["starts"].append(s.start)
        out["ends"].append(s.end)
        out["groups"].append(s.group)
        out["refs"] += [at.get(w, -1) for w in s.words]
        out["feats"] += s.features
    for w, (n, k) in words.items():
        out["h"].append(xxhash.xxh3_64_intdigest("\x1f".join(w)) - 2**63)
        out["seen"].append(n)
        out["plain"].append(k)
    return out


def _flat(lists: list[list], kind: pa.DataType) -> pa.Array:
    """Many lists as one Arrow column, through one flat numpy array."""
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    values = np.fromiter((v for x in lists for v in x), dtype=kind.to_pandas_dtype(), count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, rows = [], [], []
        for doc_id, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = encode(text)
            if found["kinds"]:
                ids.append(doc_id)
                marks.append(mark)
                rows.append(found)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), *(_flat([r[n] for r in rows], t) for n, t in [*_SPANS, *_WORDS])], schema=_CANDIDATES)


def level(seen, plain):
    """-1 if a word isn't seen elsewhere, else 0 to 3 by the smoothed share of plain sightings: coarse, so that no tree learns single words."""
    share = (plain + 0.2) / (seen + 2.0)
    return np.where(seen > 0, (share > 0.05).astype(float) + (share > 0.2) + (share > 0.5), -1.0)


def _level_column(seen: Column, plain: Column) -> Column:
    share = (plain + 0.2) / (seen + 2.0)
    return F.when(seen <= 0, -1.0).otherwise((share > 0.05).cast("double") + (share > 0.2).cast("double") + (share > 0.5).cast("double")).cast("float")


class Spans:
    """The spans of many texts as arrays, with one feature matrix for each kind."""

    def __init__(self, kinds, starts, ends, groups, refs, feats, row, levels, first_level):
        self.kinds, self.starts, self.ends, self.row = kinds, starts, ends, row
        refs = refs.reshape(-1, 2)
        padded = np.append(levels, -1.0)  # the last place is for words that there are none of
        base = first_level[row][:, None]
        word = padded[np.where(refs >= 0, refs + base, len(levels))] if len(refs) else np.zeros((0, 2))
        size = np.array(OWN_FEATURES)[kinds] if len(kinds) else np.zeros(0, dtype=int)
        offset = np.concatenate([[0], np.cumsum(size)])[:-1].astype(int) if len(kinds) else np.zeros(0, dtype=int)
        self.at, self.x = [], []
        for k in range(len(KINDS)):
            at = np.flatnonzero(kinds == k)
            x = feats[offset[at][:, None] + np.arange(OWN_FEATURES[k])] if len(at) else np.zeros((0, OWN_FEATURES[k]))
            if k == 0:
                # a name without any sign is one only if its words are names elsewhere
                sign = (x[:, SIGNS] > 0).any(axis=1) if len(at) else np.zeros(0, dtype=bool)
                keep = sign | (word[at] > 0).any(axis=1)
                at, x = at[keep], x[keep]
                x = np.hstack([x, word[at]])
            elif WORD_FEATURES[k]:
                _, where = np.unique(np.stack([row[at], groups[at]]), axis=1, return_inverse=True) if len(at) else (None, np.zeros(0, dtype=int))
                where = np.asarray(where).reshape(-1)
                best = np.full((where.max() + 1 if len(at) else 0, 2), -1.0)
                np.maximum.at(best, where, word[at])
                x = np.hstack([x, word[at][:, :1], best[where][:, :1] - word[at][:, :1], word[at][:, 1:], best[where][:, 1:] - word[at][:, 1:]])
            self.at.append(at)
            self.x.append(x)


def prepared(texts: list[str]) -> Spans:
    """The spans of texts that are each other's corpus."""
    encoded = [encode(t) for t in texts]
    seen: Counter = Counter()
    plain: Counter = Counter()
    for e in encoded:
        for h, n, k in zip(e["h"], e["seen"], e["plain"], strict=True):
            seen[h] += n
            plain[h] += k
    words = [(seen[h] - n, plain[h] - k) for e in encoded for h, n, k in zip(e["h"], e["seen"], e["plain"], strict=True)]
    levels = level(*np.array(words, dtype=float).reshape(-1, 2).T)
    lists = {n: np.array([v for e in encoded for v in e[n]], dtype=t.to_pandas_dtype()) for n, t in _SPANS}
    row = np.repeat(np.arange(len(encoded)), [len(e["kinds"]) for e in encoded])
    first = np.concatenate([[0], np.cumsum([len(e["h"]) for e in encoded])])[:-1].astype(int)
    return Spans(*(lists[n] for n, _ in _SPANS), row, levels, first)


def fit(texts: int = TRAINING_TEXTS, seed: int = 7) -> list[tuple[Boosted, float]]:
    """A forest and a threshold for each kind, from ``texts`` invented labelled texts."""
    docs = sample(texts, seed)
    found = prepared([t for t, _ in docs])
    true = {(i, k, a, b) for i, (_, marked) in enumerate(docs) for k, a, b in marked}
    out = []
    for k, kind in enumerate(KINDS):
        at, x = found.at[k], found.x[k]
        y = np.array([(int(found.row[i]), kind, int(found.starts[i]), int(found.ends[i])) in true for i in at], dtype=float)
        held = found.row[at] % 3 == 0
        model = Boosted().fit(x[~held], y[~held], x[held], y[held])
        out.append((model, best_threshold(model.probability(x[held]), y[held])))
    return out


@lru_cache(maxsize=2)
def fitted(texts: int = TRAINING_TEXTS, seed: int = 7) -> list[tuple[Boosted, float]]:
    return fit(texts, seed)


def judge(found: Spans, models: list[tuple[Boosted, float]]) -> list[tuple[int, int, int, int]]:
    """(text, start, end, kind) of spans over their threshold that don't overlap: the likeliest first, then the longer."""
    picked: dict[int, list[tuple]] = {}
    for k, (model, threshold) in enumerate(models):
        if len(found.at[k]):
            p = model.probability(found.x[k])
            for i, v in zip(found.at[k][p >= threshold].tolist(), p[p >= threshold].tolist(), strict=True):
                start, end = int(found.starts[i]), int(found.ends[i])
                picked.setdefault(int(found.row[i]), []).append((-round(v, 3), start - end, start, end, k))
    out = []
    for row, options in sorted(picked.items()):
        taken: list[tuple[int, int, int]] = []
        for _, _, start, end, k in sorted(options):
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, k))
        out += [(row, a, b, k) for a, b, k in sorted(taken)]
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("pii_kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])
_FOUND_DDL = "doc_id bigint, mark bigint, pii_kind string, start_pos int, end_pos int"


def _select(batches: Iterator[pa.RecordBatch], models: list[tuple[Boosted, float]], chunk: int = 2000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, chunk):
            batch = whole.slice(begin, chunk)
            column = lambda n: batch.column(batch.schema.names.index(n))  # noqa: B023, E731
            flat = lambda n: column(n).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            row = np.repeat(np.arange(batch.num_rows), column("kinds").value_lengths().to_numpy(zero_copy_only=False))
            sizes = column("levels").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(int)
            found = judge(Spans(*(flat(n) for n, _ in _SPANS), row, flat("levels").astype(float), first), models)
            if found:
                rows, starts, ends, kinds = (np.array(c) for c in zip(*found, strict=True))
                ids = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([column("doc_id").take(ids), column("mark").take(ids), pa.array([KINDS[k] for k in kinds]), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_FOUND)


def _places(documents: DataFrame, texts: int) -> DataFrame:
    """``doc_id, mark, pii_kind, start_pos, end_pos``; ``mark`` is a hash of the text."""
    read = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    made = materialize(read.mapInArrow(_propose, _CANDIDATES_DDL).withColumn("place", F.monotonically_increasing_id()), "spans")
    words = made.select("place", F.posexplode(F.arrays_zip("h", "seen", "plain")).alias("i", "w")).select("place", "i", "w.*")
    total = words.groupBy("h").agg(F.sum("seen").alias("all_seen"), F.sum("plain").alias("all_plain"))
    known = words.join(total, "h").select("place", F.struct("i", _level_column(F.col("all_seen") - F.col("seen"), F.col("all_plain") - F.col("plain")).alias("v")).alias("x"))
    # a text's own words only
    levels = known.groupBy("place").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("levels"))
    full = made.drop("h", "seen", "plain").join(levels, "place", "left").withColumn("levels", F.coalesce("levels", F.expr("cast(array() as array<float>)")))
    return full.drop("place").mapInArrow(partial(_select, models=fitted(texts)), _FOUND_DDL)


def find_pii(documents: DataFrame, texts: int = TRAINING_TEXTS) -> DataFrame:
    """``doc_id, pii_kind, start_pos, end_pos``: each place in the text, in code points from 0, end exclusive.

    Null and empty texts have none; spans don't overlap; repeated rows give
    repeated places; other columns are ignored; an empty table gives an empty
    result.
    """
    return _places(documents, texts).drop("mark")


_REDACTED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("redactions", pa.int32())])


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            done, pieces = 0, []
            for s in found or []:
                pieces += [text[done : s["start_pos"]], PLACEHOLDERS[s["pii_kind"]]]
                done = s["end_pos"]
            out.append({"doc_id": doc_id, "text": None if text is None else "".join(pieces) + text[done:], "redactions": len(found or [])})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_REDACTED)


def redact(documents: DataFrame, texts: int = TRAINING_TEXTS) -> DataFrame:
    """``doc_id, text, redactions``: the texts with typed placeholders; a null text stays null, repeated rows stay repeated."""
    places = _places(documents, texts)
    # equal texts of one id show the same places, each of them once
    found = places.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_kind"))).alias("found"))
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    joined = own.join(found.withColumnsRenamed({"doc_id": "id", "mark": "m"}), F.expr("doc_id <=> id and mark = m"), "left")
    return joined.select("doc_id", "text", "found").mapInArrow(_replace, "doc_id bigint, text string, redactions int")
