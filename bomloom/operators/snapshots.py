"""What changed between consecutive full snapshots of many keyed groups.

Only a 128-bit key hash, a 128-bit row hash and a row id travel through the
shuffle.  Each hash bucket is sorted once in numpy; additions and removals are
set differences found with ``searchsorted`` between a snapshot and its
successor, changes are equal keys with unequal row hashes.  The number of
buckets follows the number of rows, so a bucket's arrays stay small at any size.
Full values are fetched afterwards, for the differing keys alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.hashing import hash_pair
from bomloom.runtime import materialize

_COMPACT = "k1 bigint, k2 bigint, snap int, prev int, next int, loaded bigint, row_id bigint, r1 bigint, r2 bigint"
_EVENT = pa.schema([("row_id", pa.int64()), ("snap", pa.int32()), ("kind", pa.string()), ("old_row_id", pa.int64())])


def _latest(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sort by key and snapshot; of repeated rows keep the last loaded one."""
    order = np.lexsort((a["row_id"], a["loaded"], a["snap"], a["k2"], a["k1"]))
    a = {n: v[order] for n, v in a.items()}
    if len(order) == 0:
        return a
    last = np.ones(len(order), dtype=bool)
    last[:-1] = (a["k1"][1:] != a["k1"][:-1]) | (a["k2"][1:] != a["k2"][:-1]) | (a["snap"][1:] != a["snap"][:-1])
    return {n: v[last] for n, v in a.items()}


def _arrays(batches: list[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return {n: t.column(n).to_numpy() for n in names}


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: a hot key leaves a partition once per snapshot."""
    for batch in batches:
        names = batch.schema.names
        a = _latest(_arrays([batch], names))
        yield pa.RecordBatch.from_arrays([pa.array(a[n], type=batch.schema.field(n).type) for n in names], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a = _latest(_arrays(held, held[0].schema.names))
    del held
    n = len(a["snap"])
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (a["k1"][1:] != a["k1"][:-1]) | (a["k2"][1:] != a["k2"][:-1])
    key = np.cumsum(fresh) - 1
    snaps = np.unique(np.concatenate([a["snap"], a["prev"], a["next"]]))
    width = len(snaps)
    here = key * width + np.searchsorted(snaps, a["snap"])  # ascending: the rows are sorted

    def find(other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = key * width + np.searchsorted(snaps, other)
        at = np.minimum(np.searchsorted(here, wanted), n - 1)
        return at, here[at] == wanted

    out = []
    has_prev, has_next = a["prev"] != _NONE, a["next"] != _NONE
    at, found = find(a["prev"])
    for kind, rows, snap, old in (
        ("added", has_prev & ~found, a["snap"], None),
        ("changed", has_prev & found & ((a["r1"] != a["r1"][at]) | (a["r2"] != a["r2"][at])), a["snap"], a["row_id"][at]),
        ("removed", has_next & ~find(a["next"])[1], a["next"], None),
    ):
        ids = a["row_id"][rows]
        before = pa.array(old[rows]) if old is not None else pa.nulls(len(ids), pa.int64())
        out.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(snap[rows].astype(np.int32)), pa.array([kind] * len(ids), pa.string()), before], schema=_EVENT))
    yield from out


_NONE = -(2**31)

#: Rows of a hash bucket on average: some 60 MB of arrays and their sorted copy.
ROWS_PER_BUCKET = 500_000
#: Changes whose ids are sent to every executor (16 MB); more are joined by shuffling.
BROADCAST_CHANGES = 1_000_000


def snapshot_changes(
    rows: DataFrame,
    group: str,
    key: str,
    snap: str,
    loaded: str,
    row_id: str,
    values: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Changes of every group between its consecutive snapshots.

    Returns ``row_id, snap, kind, old_row_id``: the row that was added, changed
    (the new row; ``old_row_id`` is the one before it) or removed (the last row
    that held the key), and the snapshot in which that shows.

    * A group's previous snapshot is the latest earlier one with any row of it;
      its first snapshot has no changes.
    * Of rows with equal group, key and snapshot the last loaded one stands,
      among equals the one with the largest row id; a null load time is oldest.
    * Null is a value in ``values`` and in ``key``; rows whose group, snapshot
      or row id is null belong to no snapshot and are left out.
    * Other columns, whatever their names, are ignored.  An empty table gives an
      empty result.
    """
    k1, k2 = hash_pair(F.col(group), F.col(key))
    r1, r2 = hash_pair(*[F.col(v) for v in values])
    (g1, g2) = hash_pair(F.col(group))
    base = rows.where(F.col(group).isNotNull() & F.col(snap).isNotNull() & F.col(row_id).isNotNull()).select(
        g1.alias("g1"),
        g2.alias("g2"),
        k1.alias("k1"),
        k2.alias("k2"),
        F.col(snap).cast("int").alias("snap"),
        F.coalesce(_micros(rows, loaded), F.lit(-(2**63))).alias("loaded"),
        F.col(row_id).cast("bigint").alias("row_id"),
        r1.alias("r1"),
        r2.alias("r2"),
    )
    w = Window.partitionBy("g1", "g2").orderBy("snap")
    present = base.groupBy("g1", "g2", "snap").agg(F.lit(1).alias("one")).select(
        "g1", "g2", "snap", F.lag("snap").over(w).alias("prev"), F.lead("snap").over(w).alias("next")
    )
    compact = base.join(present, ["g1", "g2", "snap"]).select(
        "k1", "k2", "snap", F.coalesce("prev", F.lit(_NONE)).alias("prev"), F.coalesce("next", F.lit(_NONE)).alias("next"), "loaded", "row_id", "r1", "r2"
    )
    spark = rows.sparkSession
    # Parquet answers the count from its footers
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows.count() // rows_per_bucket))
    parted = compact.mapInArrow(_combine, _COMPACT).repartition(buckets, "k1", "k2")
    return parted.mapInArrow(_compare, "row_id bigint, snap int, kind string, old_row_id bigint")


def _micros(rows: DataFrame, name: str) -> Column:
    """A load time as BIGINT: microseconds of a timestamp, else the number."""
    kind = dict(rows.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    return F.col(name).cast("bigint")


def with_values(changes: DataFrame, rows: DataFrame, row_id: str, columns: list[str], most_broadcast: int = BROADCAST_CHANGES) -> DataFrame:
    """Fetch full values of the changed rows only (``old_``/``new_`` columns are left to the caller).

    The changes are written and counted: up to ``most_broadcast`` of them go to the
    table's scan, so that no unchanged row is shuffled; more are joined by shuffling.
    """
    wanted = rows.select(F.col(row_id).alias("row_id"), *columns)
    changes = materialize(changes, "changes")
    few = changes.count() <= most_broadcast
    return wanted.join(F.broadcast(changes) if few else changes, "row_id")
