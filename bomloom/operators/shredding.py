"""Nested JSON documents to related flat tables, by shared inlining.

The element graph of all documents is analysed first: its nodes are element
names, its edges say which element was found inside which, whether as object or
scalar, and whether repeated.  The document root, every repeated element and
every object element that is shared by several parents or recursive gets a
table of its own; all other descendants are inlined into the table of their
nearest ancestor as dotted columns.  Scalars without repetition are always
inlined.  Each row carries its parent's table, row number and positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomloom.functions.jsontext import leaf_text, parse, storable
from bomloom.runtime import materialize

ROOT = ""
#: An object with more different keys than this is a map whose keys are data.
MOST_FIELDS = 1000
#: Most edges of the element graph that are sent to the driver; beyond it maps are folded in Spark first.
MOST_EDGES = 100_000
KEY = "*key"
_EDGE = pa.schema([("parent", pa.string()), ("child", pa.string()), ("kind", pa.string()), ("repeated", pa.bool_())])
_ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("table_name", pa.string()),
        ("node_no", pa.int32()),
        ("parent_table", pa.string()),
        ("parent_no", pa.int32()),
        ("pos", pa.int32()),
        ("path", pa.string()),
        ("positions", pa.list_(pa.int32())),
        ("cols", pa.map_(pa.string(), pa.string())),
    ]
)
_ROW_DDL = (
    "doc_id bigint, table_name string, node_no int, parent_table string, parent_no int, pos int, path string, positions array<int>, cols map<string,string>"
)


def unwrap(doc: Any, markers: tuple[str, ...]) -> dict | None:
    """The document: the object with a marker field, or such an object inside one wrapping object."""
    if not isinstance(doc, dict):
        return None
    if not markers or any(m in doc for m in markers):
        return doc
    return next((v for v in doc.values() if isinstance(v, dict) and any(m in v for m in markers)), doc)


def _items(value: Any) -> Iterator[Any]:
    """The elements of a value: a list's (nested lists in order), or the value itself."""
    if isinstance(value, list):
        for v in value:
            yield from _items(v) if isinstance(v, list) else (v,)
    else:
        yield value


def _edges(batches: Iterator[pa.RecordBatch], markers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[tuple[str, str, str, bool]] = set()
        for body in batch.column(0).to_pylist():
            doc = unwrap(parse(body), markers)
            stack = [(ROOT, doc)] if doc is not None else []
            while stack:
                name, obj = stack.pop()
                for key, value in obj.items():
                    many = isinstance(value, list)
                    for item in _items(value):
                        if isinstance(item, dict):
                            found.add((name, key, "object", many))
                            stack.append((key, item))
                        elif item is not None:
                            found.add((name, key, "scalar", many))
        if found:
            yield pa.RecordBatch.from_pylist([{"parent": storable(p), "child": storable(c), "kind": k, "repeated": r} for p, c, k, r in found], schema=_EDGE)


@dataclass(frozen=True)
class TablePlan:
    """Which elements have tables, which are maps keyed by data, and the element graph they come from."""

    tables: frozenset[str]
    parents: dict[str, frozenset[str]] = field(hash=False)
    children: dict[str, frozenset[str]] = field(hash=False)
    maps: frozenset[str] = frozenset()

    def leading_to(self, wanted: frozenset[str]) -> frozenset[str]:
        """The elements on any way from the root to ``wanted``: all others need no visit."""
        reach, todo = set(wanted), list(wanted)
        while todo:
            for p in self.parents.get(todo.pop(), ()):
                if p not in reach:
                    reach.add(p)
                    todo.append(p)
        return frozenset(reach)

    def home(self, path: tuple[str, ...]) -> tuple[str, int, str]:
        """Where a leaf path is stored: table, how many elements of the path lead to its row, column."""
        for n in range(len(path), 0, -1):
            if path[n - 1] in self.tables:
                return path[n - 1], n, ".".join(path[n:])
        return ROOT, 0, ".".join(path)


_Edge = tuple[str, str, str, bool]


def _wide(edges: DataFrame, most_fields: int) -> DataFrame:
    own = edges.where(~F.col("child").endswith(".*"))
    return own.groupBy("parent").agg(F.count_distinct("child").alias("n")).where(F.col("n") > most_fields).select("parent")


def _fold(edges: DataFrame, most_fields: int) -> tuple[DataFrame, DataFrame]:
    """The edges with the entries of every map folded into ``name.*``, and the maps; maps inside maps need another round."""
    wide = materialize(_wide(edges, most_fields), "maps")
    inside = edges.join(wide, "parent").select("parent", "child").distinct()
    elsewhere = edges.join(wide, "parent", "left_anti").select("child").distinct()
    # what lies below an entry belongs to name.*, unless the key also names an element of its own
    below = inside.join(elsewhere, "child", "left_anti").groupBy("child").agg(F.min("parent").alias("owner"))
    folded = edges.join(wide.withColumn("map", F.lit(True)), "parent", "left").join(below.withColumnRenamed("child", "parent"), "parent", "left")
    child = F.when(F.col("map"), F.concat("parent", F.lit(".*"))).otherwise(F.col("child"))
    parent = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit(".*"))).otherwise(F.col("parent"))
    out = folded.select(parent.alias("parent"), child.alias("child"), "kind", (F.col("repeated") | F.col("map").isNotNull()).alias("repeated")).distinct()
    return materialize(out, "folded"), wide


def element_graph(docs: DataFrame, body: str, markers: tuple[str, ...] = (), most_fields: int = MOST_FIELDS, most_edges: int = MOST_EDGES) -> tuple[list[_Edge], frozenset[str]]:
    """(parent, child, kind, repeated) of all documents with maps folded, and the names of the maps.

    Raises if a schema without maps has more than ``most_edges`` edges: such
    documents have no schema to build tables from.
    """
    raw = docs.where(F.col(body).isNotNull()).select(F.col(body))
    edges = materialize(raw.mapInArrow(partial(_edges, markers=markers), "parent string, child string, kind string, repeated boolean").distinct(), "elements")
    maps: set[str] = set()
    while True:
        wide = _wide(edges, most_fields).limit(most_edges + 1).collect()
        if not wide:
            break
        if len(wide) > most_edges:
            raise ValueError(f"more than {most_edges} elements are maps")
        maps |= {r.parent for r in wide}
        edges, _ = _fold(edges, most_fields)
    found = edges.limit(most_edges + 1).collect()
    if len(found) > most_edges:
        raise ValueError(f"the element graph has more than {most_edges} edges")
    return [tuple(e) for e in found], frozenset(maps)


def analyse(docs: DataFrame, body: str, markers: tuple[str, ...] = (), most_fields: int = MOST_FIELDS) -> TablePlan:
    """Build the element graph from every document and decide on the tables.

    What reaches the driver is the graph: one row for each kind of edge, whatever
    the number of documents and of keys in maps (see ``element_graph``).
    """
    found, maps = element_graph(docs, body, markers, most_fields)
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    objects, repeated = set(), set()
    for parent, child, kind, many in found:
        children.setdefault(parent, set()).add(child)
        parents.setdefault(child, set()).add(parent)
        if kind == "object":
            objects.add(child)
        if many:
            repeated.add(child)
    shared = {c for c in objects if len(parents[c]) > 1}
    recursive = {c for c in objects if _reaches(c, c, children)}
    tables = frozenset({ROOT} | repeated | shared | recursive)
    return TablePlan(tables, {k: frozenset(v) for k, v in parents.items()}, {k: frozenset(v) for k, v in children.items()}, maps)


def _reaches(start: str, goal: str, children: dict[str, set[str]]) -> bool:
    seen, todo = set(), [start]
    while todo:
        for c in children.get(todo.pop(), ()):
            if c == goal:
                return True
            if c not in seen:
                seen.add(c)
                todo.append(c)
    return False


def _shred(batches: Iterator[pa.RecordBatch], tables: frozenset[str], maps: frozenset[str], emit: frozenset[str], visit: frozenset[str], columns: frozenset[str] | None, markers: tuple[str, ...], chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = unwrap(parse(body), markers)
            if doc is None:
                continue
            number = 0
            # (element, value, parent table, parent number, position, path, positions, key in a map)
            stack: list[tuple] = [(ROOT, doc, None, None, 0, "", (), None)]
            while stack:
                name, value, ptable, pno, pos, path, positions, entry = stack.pop()
                number += 1
                me, cols, below = number, {} if entry is None else {KEY: storable(entry)}, []
                inner = [(name, "", path, value)]
                while inner:
                    element, prefix, at, obj = inner.pop()
                    if not isinstance(obj, dict):
                        if obj is not None and (columns is None or prefix in columns):
                            cols[prefix] = leaf_text(obj)
                        continue
                    if element in maps:
                        star = f"{element}.*"
                        here = f"{at}.*" if at else "*"
                        entries = [(k, item) for k, v in obj.items() for item in _items(v)]
                        if star in visit:
                            below += [(star, item, name, me, i, here, (*positions, i), k) for i, (k, item) in enumerate(entries) if item is not None]
                        continue
                    for key, v in obj.items():
                        if key in tables:
                            if key in visit:
                                here = f"{at}.{key}" if at else key
                                below += [(key, item, name, me, i, here, (*positions, i), None) for i, item in enumerate(_items(v)) if item is not None]
                        else:
                            inner.append((key, f"{prefix}.{key}" if prefix else key, f"{at}.{key}" if at else key, v))
                stack.extend(reversed(below))
                if name in emit:
                    out.append({"doc_id": doc_id, "table_name": name, "node_no": me, "parent_table": ptable, "parent_no": pno, "pos": pos, "path": storable(path), "positions": list(positions), "cols": [(storable(k), x) for k, x in cols.items()]})
                    if len(out) >= chunk:
                        yield pa.RecordBatch.from_pylist(out, schema=_ROW)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ROW)


def shred(docs: DataFrame, doc_id: str, body: str, plan: TablePlan, markers: tuple[str, ...] = (), only: dict[str, set[str]] | None = None) -> DataFrame:
    """All rows of the planned tables in one pass over the documents.

    Returns ``doc_id, table_name, node_no, parent_table, parent_no, pos, path,
    positions, cols``: (doc_id, node_no) is a row's key, (doc_id, parent_no) the
    foreign key into ``parent_table``; ``pos`` counts from 0 in the array that
    held the element, an object in place of an array is at 0; ``path`` and
    ``positions`` name the elements with tables on the way from the root, so that
    a parent's position needs no join.  ``cols`` holds the inlined leaves as
    text (a repeated scalar's own text under the empty name, a map entry's key
    under ``*key``).

    ``only`` maps wanted tables to wanted columns; elements that lead to none of
    them aren't visited.  Null elements have no row but keep their place in the
    count.  Bodies that aren't valid JSON, or no object, have no rows.
    """
    emit = frozenset(only) if only is not None else plan.tables
    columns = frozenset().union(*only.values()) if only is not None else None
    work = partial(_shred, tables=plan.tables, maps=plan.maps, emit=emit, visit=plan.leading_to(emit), columns=columns, markers=markers)
    raw = docs.where(F.col(body).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).alias("body"))
    return raw.mapInArrow(work, _ROW_DDL)


def flat_table(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One relational table of the shredded rows, its inlined leaves as columns."""
    picked = [F.col("cols")[c].alias(c.replace(".", "_") or "value") for c in columns]
    return rows.where(F.col("table_name") == name).select("doc_id", "node_no", "parent_table", "parent_no", "pos", *picked)


def leaf_values(docs: DataFrame, doc_id: str, body: str, leaves: dict[str, tuple[str, ...]], markers: tuple[str, ...]) -> DataFrame:
    """``doc_id, kind, parent_pos, child_pos, leaf_value`` of non-empty leaves two levels below the document.

    ``leaves`` maps a kind to its path; the first element is the parent, the
    second the child.  The table that holds each leaf is looked up in the plan.
    """
    plan = analyse(docs, body, markers)
    homes = {kind: plan.home(path) for kind, path in leaves.items()}
    only: dict[str, set[str]] = {}
    for table, _, column in homes.values():
        only.setdefault(table, set()).add(column)
    rows = shred(docs, doc_id, body, plan, markers, only)
    branches = []
    for kind, path in leaves.items():
        table, depth, column = homes[kind]
        steps = [p for p in path[:depth] if p in plan.tables]

        def position(element: str, depth: int = depth, steps: list[str] = steps, path: tuple[str, ...] = path):
            inside = element in path[:depth] and element in steps
            return F.col("positions")[steps.index(element)] if inside else F.lit(0)

        here = (F.col("table_name") == table) & (F.col("path") == ".".join(path[:depth]))
        value = F.col("cols")[column]
        branches.append((here & (F.length(value) > 0), F.struct(F.lit(kind).alias("kind"), position(path[0]).cast("int").alias("parent_pos"), position(path[1]).cast("int").alias("child_pos"), value.alias("leaf_value"))))
    picked = F.filter(F.array(*[F.when(c, s) for c, s in branches]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(picked).alias("x")).select("doc_id", "x.*")
