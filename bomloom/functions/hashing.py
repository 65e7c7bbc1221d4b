"""Hash expressions that are independent of each other and null-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def marked(col: Column) -> Column:
    """A string that tells null from every value (xxhash64 skips nulls)."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two BIGINTs; fields are kept apart and null is a value."""
    parts = [marked(c) for c in cols]
    return F.xxhash64(F.lit(len(parts)), *parts), F.xxhash64(*reversed(parts), F.lit("second"))
