"""Registered queries of the core: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bomloom.queries import fleetwide, general, graphs, inout, scalar


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return general.QUERIES | fleetwide.QUERIES | graphs.QUERIES | inout.QUERIES | scalar.QUERIES


def oracle_sql() -> dict[str, str]:
    return general.SQL | fleetwide.SQL | graphs.SQL | inout.SQL | scalar.SQL
