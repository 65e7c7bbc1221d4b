"""Schemas that drift between files: schema versions, migration steps, change log, one table.

Every record is parsed once.  Each file of a feed has a schema fingerprint: its
leaf paths with their type sets; runs of files with one fingerprint are a
version.  Between two versions stand explicit migration steps: rename, default
(for a new field), cast (for other types) and drop; where paths go and others
come, the values of the records that both neighbouring files hold decide which
are renames.  The change log is the list of steps, and every record is routed
through the chain of steps from its own version on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomloom.functions.jsontext import TYPE_BITS, leaves, parse, storable
from bomloom.runtime import materialize

_PARSED = pa.schema(
    [
        ("rec_no", pa.int64()), ("feed", pa.string()), ("file_no", pa.int64()), ("line_no", pa.int32()), ("valid", pa.bool_()), ("record_id", pa.string()), ("id_path", pa.string()),
        ("paths", pa.list_(pa.string())), ("bits", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())),
    ]
)
_PARSED_DDL = "rec_no bigint, feed string, file_no bigint, line_no int, valid boolean, record_id string, id_path string, paths array<string>, bits array<int>, texts array<string>"


def _parse(batches: Iterator[pa.RecordBatch], id_keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _PARSED]
        for rec_no, feed, file_no, line_no, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            doc = parse(body)
            found = list(leaves(doc))
            key = next((k for k in id_keys if doc.get(k) is not None), None) if isinstance(doc, dict) else None
            ident = None if key is None or isinstance(doc[key], (dict, list)) else storable(str(doc[key]))
            row = (rec_no, feed, file_no, line_no, isinstance(doc, dict), ident, key, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARSED, strict=True)], schema=_PARSED)


def parsed_records(records: DataFrame, id_keys: tuple[str, ...] = ("SPDXID", "bom-ref")) -> DataFrame:
    """Every record with a feed and a file, its leaves as parallel arrays ``paths, bits, texts``: the one pass over the bodies.

    ``rec_no`` and ``line_no`` may be missing from the table; they are null then.
    """
    have = set(records.columns)
    column = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    raw = records.where("feed is not null and file_no is not null").select(column("rec_no", "bigint"), "feed", column("file_no", "bigint"), column("line_no", "int"), "body")
    return materialize(raw.mapInArrow(partial(_parse, id_keys=id_keys), _PARSED_DDL), "parsed")


def file_schemas(parsed: DataFrame) -> DataFrame:
    """``feed, file_no, path, types`` (bits); each file also has a row with an empty path, even if no line of it is valid."""
    entries = F.arrays_zip(F.concat(F.array(F.lit("")), "paths").alias("path"), F.concat(F.array(F.lit(0)), "bits").alias("types"))
    return parsed.select("feed", "file_no", F.explode(entries).alias("e")).groupBy("feed", "file_no", F.col("e.path").alias("path")).agg(F.bit_or("e.types").alias("types"))


def schema_versions(schemas: DataFrame) -> DataFrame:
    """``feed, file_no, before, fingerprint, version``: runs of files with one fingerprint share a version, from 1.

    ``before`` is the file_no before it in its feed.
    """
    w = Window.partitionBy("feed").orderBy("file_no")
    entries = F.array_sort(F.collect_list(F.when(F.col("path") != "", F.concat_ws("\x1f", "path", F.col("types").cast("string")))))
    prints = schemas.groupBy("feed", "file_no").agg(F.sha2(F.array_join(entries, "\x1e"), 256).alias("fingerprint"))
    step = F.when(F.lag("fingerprint").over(w) == F.col("fingerprint"), 0).otherwise(1)
    seen = prints.withColumn("step", step).withColumn("before", F.lag("file_no").over(w))
    return seen.select("feed", "file_no", "before", "fingerprint", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("version"))


def _borders(versions: DataFrame) -> DataFrame:
    """The first file of every version but a feed's first, with the file before it."""
    w = Window.partitionBy("feed").orderBy("file_no")
    return versions.withColumn("old_version", F.lag("version").over(w)).where("old_version <> version").select("feed", "file_no", "before", "version")


def _differences(schemas: DataFrame, borders: DataFrame) -> DataFrame:
    """``feed, file_no, before, version, path, old, new``: paths whose type sets differ between the two files at a border."""
    key = ["feed", "file_no", "before", "version"]
    own = schemas.join(borders, ["feed", "file_no"]).select(*key, "path", F.lit(0).alias("old"), F.col("types").alias("new"))
    past = schemas.join(borders.withColumnsRenamed({"file_no": "target", "before": "file_no"}), ["feed", "file_no"])
    past = past.select("feed", F.col("target").alias("file_no"), F.col("file_no").alias("before"), "version", "path", F.col("types").alias("old"), F.lit(0).alias("new"))
    return own.unionByName(past).groupBy(*key, "path").agg(F.max("old").alias("old"), F.max("new").alias("new")).where("old <> new")


def _renames(parsed: DataFrame, moved: DataFrame) -> DataFrame:
    """``feed, file_no, field_path, new_path`` decided by the values of common records."""
    sides = moved.groupBy("feed", "file_no", "before").agg(
        F.collect_list(F.when(F.col("new") == 0, F.col("path"))).alias("gone"), F.collect_list(F.when(F.col("old") == 0, F.col("path"))).alias("come")
    )
    sides = sides.where((F.size("gone") > 0) & (F.size("come") > 0))
    both = F.array(
        F.struct(F.col("before").alias("file_no"), F.col("file_no").alias("target"), F.lit(False).alias("fresh"), F.col("gone").alias("wanted")),
        F.struct(F.col("file_no"), F.col("file_no").alias("target"), F.lit(True).alias("fresh"), F.col("come").alias("wanted")),
    )
    wanted = sides.select("feed", F.explode(both).alias("w")).select("feed", "w.*")
    rows = parsed.where("record_id is not null").select("feed", "file_no", F.xxhash64("record_id").alias("rec"), F.arrays_zip("paths", "texts").alias("all")).join(wanted, ["feed", "file_no"])
    held = F.transform("wanted", lambda p: F.struct(p.alias("path"), F.transform(F.filter("all", lambda x: x["paths"] == p), lambda x: x["texts"]).alias("texts")))
    values = rows.select("feed", "target", "fresh", "rec", F.explode(F.filter(held, lambda h: F.size(h["texts"]) > 0)).alias("h"))
    values = materialize(values.select("feed", "target", "fresh", "rec", "h.path", F.xxhash64("h.texts").alias("digest")).distinct(), "moved-values")
    old = values.where("not fresh").select("feed", "target", "rec", F.col("path").alias("field_path"), F.col("digest").alias("was"))
    new = values.where("fresh").select("feed", "target", "rec", F.col("path").alias("new_path"), F.col("digest").alias("now"))
    per_record = old.join(new, ["feed", "target", "rec"]).groupBy("feed", "target", "field_path", "new_path", "rec").agg(F.max((F.col("was") == F.col("now")).cast("int")).alias("same"))
    scored = per_record.groupBy("feed", "target", "field_path", "new_path").agg(F.sum("same").alias("same"), F.count("*").alias("both"))
    # one file's candidates are bounded by its number of fields
    best = scored.where("same * 2 > both").groupBy("feed", "target").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("same")).alias("a"), (-F.col("same") / F.col("both")).alias("b"), "field_path", "new_path"))).alias("pairs")
    )

    def take(chosen: Column, pair: Column) -> Column:
        clash = F.exists(chosen, lambda c: (c["field_path"] == pair["field_path"]) | (c["new_path"] == pair["new_path"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(pair)))

    chosen = F.aggregate("pairs", F.slice("pairs", 1, 0), take)
    return best.select("feed", F.col("target").alias("file_no"), F.explode(chosen).alias("p")).select("feed", "file_no", "p.field_path", "p.new_path")


def migration_steps(parsed: DataFrame, schemas: DataFrame, versions: DataFrame) -> DataFrame:
    """``feed, version, file_no, step, field_path, new_path, old_types, new_types``: what leads from the version before to ``version``.

    ``file_no`` is the version's first file.  ``rename``: a gone and a new path
    agree, as text, in more than half of the records (by their identifier) that
    hold both; a file delivered twice counts once; pairs are one to one, most
    agreeing records first, ties by share and then by name.  ``default``: a new
    path, absent from older records.  ``cast``: its set of string, number and
    boolean differs (a rename may need one too).  ``drop``: a gone path.
    """
    diff = materialize(_differences(schemas, _borders(versions)), "schema-diff")
    moved = diff.where("old = 0 or new = 0")
    renamed = materialize(_renames(parsed, moved), "renames")
    columns = ["feed", "version", "file_no", "step", "field_path", "new_path", "old_types", "new_types"]
    types = moved.select("feed", "file_no", "version", "path", "old", "new")
    gone = types.where("new = 0").select("feed", "file_no", "version", F.col("path").alias("field_path"), F.col("old").alias("old_types"))
    come = types.where("old = 0").select("feed", "file_no", F.col("path").alias("new_path"), F.col("new").alias("new_types"))
    named = renamed.join(gone, ["feed", "file_no", "field_path"]).join(come, ["feed", "file_no", "new_path"]).withColumn("step", F.lit("rename")).select(columns)
    taken = renamed.select("feed", "file_no", F.explode(F.array("field_path", "new_path")).alias("path"))
    rest = moved.join(taken, ["feed", "file_no", "path"], "left_anti").withColumn("step", F.when(F.col("new") == 0, "drop").otherwise("default"))
    own = rest.unionByName(diff.where("old <> 0 and new <> 0").withColumn("step", F.lit("cast")))
    own = own.select("feed", "version", "file_no", "step", F.col("path").alias("field_path"), F.lit("").alias("new_path"), F.col("old").alias("old_types"), F.col("new").alias("new_types"))
    return materialize(own.unionByName(named), "steps")


CHANGE_KINDS = {"rename": "renamed", "default": "added", "cast": "retyped", "drop": "removed"}


def schema_changes(records: DataFrame, id_keys: tuple[str, ...] = ("SPDXID", "bom-ref")) -> DataFrame:
    """``feed, file_no, change_kind, field_path, new_path`` of every file against the one before it: the migration steps by file.

    ``records`` needs ``feed, file_no, body``; further columns are ignored.
    Files of one version don't differ, so every change stands at a version's
    first file.  Nulls, absent fields and lines that aren't valid JSON don't
    count; a file of only such lines has no paths.  Rows without feed or file_no
    are left out.  Empty input gives an empty result.
    """
    parsed, _, steps = _migrated(records, id_keys)
    kind = F.create_map(*[F.lit(x) for kv in CHANGE_KINDS.items() for x in kv])[F.col("step")]
    return steps.select("feed", "file_no", kind.alias("change_kind"), "field_path", "new_path")


def _migrated(records: DataFrame, id_keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parsed records, the versions of the files and the steps between versions."""
    parsed = parsed_records(records, id_keys)
    schemas = materialize(file_schemas(parsed), "file-schemas")
    versions = materialize(schema_versions(schemas), "versions")
    return parsed, versions, migration_steps(parsed, schemas, versions)


def version_steps(records: DataFrame, id_keys: tuple[str, ...] = ("SPDXID", "bom-ref")) -> DataFrame:
    """``feed, version, file_no, fingerprint, step, field_path, new_path, old_types, new_types``: every step with the version it leads to.

    A feed's first version has no steps and one row with the step ``first``.
    """
    _, versions, steps = _migrated(records, id_keys)
    first = versions.groupBy("feed", "version").agg(F.min("file_no").alias("file_no"), F.min("fingerprint").alias("fingerprint"))
    named = steps.withColumns({"old_types": type_names(F.col("old_types")), "new_types": type_names(F.col("new_types"))})
    out = first.join(named.drop("file_no"), ["feed", "version"], "left").withColumn("step", F.coalesce("step", F.lit("first")))
    return out.select("feed", "version", "file_no", "fingerprint", "step", *[F.coalesce(c, F.lit("")).alias(c) for c in ("field_path", "new_path", "old_types", "new_types")])


_ROUTE = pa.schema([("feed", pa.string()), ("version", pa.int32()), ("names", pa.map_(pa.string(), pa.string()))])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions of a feed arrive last to first; ``names`` maps a version's paths to the last names of their chains.

    Held at a time: the mapping of one feed, which has as many entries as the feed had renames in force.
    """
    feed, names = None, {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["feed"] != feed:
                feed, names = row["feed"], {}
            out.append({"feed": feed, "version": row["version"], "names": list(names.items())})
            fresh = {p["new_path"]: p["field_path"] for p in row["renames"]}
            names = {**{k: v for k, v in names.items() if k not in fresh}, **{old: names.get(new, new) for new, old in fresh.items()}}
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ROUTE)


def routes(versions: DataFrame, steps: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """``feed, version, names, homes``: a version's paths to the last names of their chains, and those to output columns.

    A chain belongs to the column that has one of its names, at whatever version
    the feed used it, among its standard names; so a field stays in its column
    under names that no list foresees.
    """
    none = "cast(array() as array<struct<field_path: string, new_path: string>>)"
    renames = steps.where("step = 'rename'").groupBy("feed", "version").agg(F.collect_list(F.struct("field_path", "new_path")).alias("renames"))
    ordered = versions.select("feed", "version").distinct().join(renames, ["feed", "version"], "left").withColumn("renames", F.coalesce("renames", F.expr(none)))
    ordered = ordered.repartition("feed").sortWithinPartitions("feed", F.desc("version"))
    made = materialize(ordered.mapInArrow(_chains, "feed string, version int, names map<string,string>"), "routes")
    standard = F.create_map(*[F.lit(x) for column, names in columns.items() for n in names for x in (n, column)])
    links = made.select("feed", F.explode("names").alias("was", "last"))
    links = links.unionByName(links.select("feed", F.col("last").alias("was"), "last"))
    homes = links.withColumn("home", standard[F.col("was")]).where("home is not null").groupBy("feed", "last").agg(F.min("home").alias("home"))
    homes = homes.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("last", "home"))).alias("homes"))
    return made.join(homes, "feed", "left").withColumn("homes", F.coalesce("homes", F.expr("cast(map() as map<string,string>)")))


def unified_records(
    records: DataFrame,
    columns: dict[str, tuple[list[str], str]],
    defaults: dict[str, str] | None = None,
    id_keys: tuple[str, ...] = ("SPDXID", "bom-ref"),
) -> DataFrame:
    """All valid records in one typed table, each routed through its feed's chain of steps.

    ``columns`` maps an output column to (standard names of the field, type); a
    record's value goes where its chain of renames belongs (see ``routes``).
    The first value, in the order of the standard names, that can be cast fills
    the column; an ``array<string>`` column keeps all values of the path.
    ``defaults`` fills columns that no value does.  ``cast_failed`` names the
    columns for which a value could not be cast.  All that is in no column stays
    in ``other``, so nothing is lost: fields of no column, further paths of a
    column, further values of a path, values that can't be cast, and a second
    identifier.  Lines that aren't JSON objects have no record.  A rec_no
    delivered twice stays twice.
    """
    parsed, versions, steps = _migrated(records, id_keys)
    route = routes(versions, steps, {c: names for c, (names, _) in columns.items()})
    at = versions.select("feed", "file_no", "version").join(route, ["feed", "version"])
    rows = parsed.where("valid").join(at, ["feed", "file_no"])
    last = F.transform("paths", lambda p: F.coalesce(F.col("names")[p], p))
    pairs = F.arrays_zip(last.alias("path"), F.col("texts").alias("text"))
    fields = F.map_from_entries(F.transform(F.array_distinct(last), lambda p: F.struct(p, F.transform(F.filter(pairs, lambda x: x["path"] == p), lambda x: x["text"]))))
    rows = rows.select("rec_no", "feed", "file_no", "line_no", "record_id", F.coalesce(F.col("names")[F.col("id_path")], "id_path").alias("id_path"), "homes", fields.alias("fields"))
    defaults = defaults or {}
    out, whole, first, failed = [], [], [F.col("id_path")], []  # paths whose values, or whose first value, are in a column
    for name, (standard, kind) in columns.items():
        rank = F.array(*[F.lit(n) for n in standard])
        home = F.array_sort(F.transform(F.map_keys(F.map_filter("fields", lambda k, _: F.coalesce(F.col("homes")[k], F.when(F.array_contains(rank, k), name)) == name)), lambda k: F.struct(F.array_position(rank, k).alias("rank"), k.alias("path"))))
        many = kind.startswith("array")
        value = lambda p: F.col("fields")[p] if many else F.get(F.col("fields")[p], F.lit(0)).try_cast(kind)  # noqa: B023, E731
        usable = F.filter(home, lambda h: value(h["path"]).isNotNull())  # noqa: B023
        path = F.get(usable, F.lit(0))["path"]
        (whole if many else first).append(path)
        failed.append(F.when((F.size(home) > 0) & path.isNull(), F.lit(name)))
        filled = value(path)
        out.append((F.coalesce(filled, F.lit(defaults[name]).cast(kind)) if name in defaults else filled).alias(name))
    taken = lambda paths, k: F.array_contains(F.array_compact(F.array(*paths, F.lit(None).cast("string"))), k)
    rest = F.map_filter("fields", lambda k, _: ~taken(whole, k))
    rest = F.transform_values(rest, lambda k, v: F.when(taken(first, k), F.slice(v, 2, F.size(v))).otherwise(v))
    other = F.map_filter(rest, lambda _, v: F.size(v) > 0).alias("other")
    return rows.select("rec_no", "feed", "file_no", "line_no", "record_id", *out, F.array_compact(F.array(*failed)).alias("cast_failed"), other)


def type_names(bits: Column) -> Column:
    """A type set as text, for reports."""
    return F.concat_ws("|", *[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for n, b in TYPE_BITS.items()])
