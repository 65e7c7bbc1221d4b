"""Records that are equal but for formatting, by external sort and adjacent scan.

Every record gets a canonical key in the JVM.  Records are range-partitioned on
(hash of the key, key, id), sorted externally inside each partition, and one
scan over adjacent rows compares full keys: a run of equal keys is one record.
As the id belongs to the range, a run of any length is spread over as many
partitions as it needs; the runs cut at a partition border are joined by one
border row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomloom.runtime import materialize

# One run of blanks and punctuation: dropped unless digits stand on both sides,
# where its punctuation is content and only its blanks go.
_GAP = r"\s\p{Z}\p{P}\p{S}"
_IGNORED = rf"(?<![\p{{Nd}}{_GAP}])[{_GAP}]+|[{_GAP}]+(?![\p{{Nd}}{_GAP}])|[\s\p{{Z}}]+"


def percent_decoded(col: Column) -> Column:
    """Percent-decoding that leaves ``+`` and stray ``%`` signs alone."""
    safe = F.regexp_replace(F.regexp_replace(col, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(col.contains("%"), F.coalesce(F.try_url_decode(safe), col)).otherwise(col)


def plain(col: Column) -> Column:
    """A decoded text without letter case, blanks and punctuation (kept between digits)."""
    return F.regexp_replace(F.lower(F.upper(col)), _IGNORED, "")


def canonical_text(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), plain(percent_decoded(col))), F.lit("n"))


def canonical_purl(col: Column) -> Column:
    """As ``canonical_text``, with the qualifiers after ``?`` in sorted order."""
    decoded = percent_decoded(col)
    parts = F.split(F.substring_index(decoded, "?", -1), "&")
    sorted_parts = F.array_join(F.array_sort(F.filter(F.transform(parts, plain), lambda x: x != "")), "\x02")
    full = F.when(decoded.contains("?"), F.concat(plain(F.substring_index(decoded, "?", 1)), F.lit("\x01"), sorted_parts)).otherwise(F.concat(plain(decoded), F.lit("\x01")))
    return F.coalesce(F.concat(F.lit("v"), full), F.lit("n"))


def canonical_set(col: Column, *fields) -> Column:
    """An array of structs as its elements' canonical fields in sorted order; null is not empty."""
    item = lambda x: F.concat_ws("\x03", *[canonical_text(f(x)) for f in fields])
    return F.when(col.isNull(), F.lit("n")).when(F.size(col) == 0, F.lit("v")).otherwise(F.concat(F.lit("v"), F.array_join(F.array_sort(F.transform(col, item)), "\x02")))


_SCAN = pa.schema(
    [
        ("kind", pa.string()),
        ("part", pa.int32()),
        ("id", pa.int64()),
        ("keep", pa.int64()),
        ("lead", pa.bool_()),
        ("copies", pa.int64()),
        ("first_key", pa.string()),
        ("last_key", pa.string()),
        ("single", pa.bool_()),
    ]
)
_SCAN_DDL = "kind string, part int, id bigint, keep bigint, lead boolean, copies bigint, first_key string, last_key string, single boolean"


def _rows(kind: str, part: int, n: int, **cols) -> pa.RecordBatch:
    made = {"kind": [kind] * n, "part": np.full(n, part, dtype=np.int32), **cols}
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else pa.nulls(n, f.type) for f in _SCAN], schema=_SCAN)


def _scan(batches: Iterator[pa.RecordBatch], want: str) -> Iterator[pa.RecordBatch]:
    """``want`` is ``copy`` (a row for each non-first row of a run) or ``run`` (a row for each run)."""
    part = TaskContext.get().partitionId()
    first_key = first_id = last_key = keep = None
    lead, count = True, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        keys, ids = batch.column("key"), batch.column("id").to_numpy()
        head = np.ones(n, dtype=bool)
        head[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if first_key is None:
            first_key, first_id = keys[0].as_py(), int(ids[0])
        else:
            head[0] = keys[0].as_py() != last_key
        starts = np.flatnonzero(head)
        at = np.maximum.accumulate(np.where(head, np.arange(n), -1))
        kept = np.where(at >= 0, ids[np.maximum(at, 0)], keep if keep is not None else 0)
        # the partition's first run, which may continue one of the partition before
        stop = starts[1] if keep is None and len(starts) > 1 else starts[0] if keep is not None and len(starts) else n
        leading = np.arange(n) < stop if lead else np.zeros(n, dtype=bool)
        if want == "copy":
            out = leading | ~head
            yield _rows("copy", part, int(out.sum()), id=ids[out], keep=kept[out], lead=leading[out])
        else:
            ends = [*starts, n] if keep is not None else [*starts[1:], n]
            firsts = [keep, *ids[starts].tolist()] if keep is not None else ids[starts].tolist()
            sizes = np.diff([0, *ends])
            sizes[0] += count
            if len(firsts) > 1:
                flags = [lead] + [False] * (len(firsts) - 2)
                yield _rows("run", part, len(firsts) - 1, keep=firsts[:-1], lead=flags, copies=sizes[:-1])
            count = int(sizes[-1])
        lead = lead and stop == n
        last_key, keep = keys[n - 1].as_py(), int(kept[-1])
    if first_key is not None:
        if want == "run":
            yield _rows("run", part, 1, keep=[keep], lead=[lead], copies=[count])
        yield _rows("border", part, 1, id=[first_id], keep=[keep], first_key=[first_key], last_key=[last_key], single=[lead])


def _fixes(borders: list) -> list[tuple[int, int]]:
    """(partition, first id of the run that its first rows continue), where there is such a run."""
    out, key, keep = [], None, None
    for b in sorted(borders, key=lambda b: b.part):
        true = keep if key == b.first_key and keep is not None else b.id
        if true != b.id:
            out.append((b.part, true))
        key, keep = b.last_key, true if b.single else b.keep
    return out


def _runs(records: DataFrame, row_id: str, key: Column, want: str) -> DataFrame:
    spark = records.sparkSession
    keyed = records.select(F.col(row_id).cast("bigint").alias("id"), key.alias("key")).where("id is not null")
    # written once: the range bounds are sampled in a pass of their own
    keyed = materialize(keyed.select(F.xxhash64("key").alias("h"), "key", "id"), "format-keys")
    ranged = keyed.repartitionByRange("h", "key", "id").sortWithinPartitions("h", "key", "id")
    scanned = materialize(ranged.select("key", "id").mapInArrow(partial(_scan, want=want), _SCAN_DDL), "format-runs")
    # one border row for each partition, whatever the number of records
    fixes = spark.createDataFrame(_fixes(scanned.where("kind = 'border'").select("part", "id", "keep", "first_key", "last_key", "single").collect()), "part int, true_keep bigint")
    rows = scanned.where(F.col("kind") == want).join(F.broadcast(fixes), "part", "left")
    return rows.withColumn("keep", F.when(F.col("lead"), F.coalesce("true_keep", "keep")).otherwise(F.col("keep")))


def copies(records: DataFrame, row_id: str, key: Column) -> DataFrame:
    """``keep_id, copy_id``: one row for each record but the smallest id of its run of equal keys.

    ``key`` must not be null (``canonical_*`` mark nulls); rows without id are
    left out, an id that occurs twice with one key is not a copy of itself.
    An empty table gives an empty result; all other columns are ignored.
    """
    rows = _runs(records, row_id, key, "copy").where("id <> keep")
    return rows.select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))


def representatives(records: DataFrame, row_id: str, key: Column) -> DataFrame:
    """``keep_id, n_copies``: one row for each distinct key, with the exact number of its records."""
    rows = _runs(records, row_id, key, "run")
    # pieces of one run that was cut at partition borders
    return rows.groupBy(F.col("keep").alias("keep_id")).agg(F.sum("copies").alias("n_copies"))


def component_key() -> Column:
    """The canonical key of a CycloneDX component row."""
    licence = canonical_set(F.col("licenses"), lambda x: x["license"]["id"], lambda x: x["license"]["name"], lambda x: x["expression"])
    properties = canonical_set(F.col("properties"), lambda x: x["name"], lambda x: x["value"])
    texts = [canonical_text(F.col(c)) for c in ("bom_serial", "comp_type", "name", "version")]
    return F.concat_ws("\x1f", *texts, canonical_purl(F.col("purl")), licence, properties)
