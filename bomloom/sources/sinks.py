"""Reports: JSON, tagged NDJSON, CSV sections, SARIF, HTML and Markdown escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SARIF levels of severities.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "none": "note", "unknown": "note"}


def tagged_rows(**sections: DataFrame) -> DataFrame:
    """``tag, body``: every row of every section as JSON, ready for ``write.text`` (NDJSON)."""
    parts = [d.select(F.lit(tag).alias("tag"), F.to_json(F.struct(F.lit(tag).alias("tag"), F.struct(*d.columns).alias("row"))).alias("body")) for tag, d in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_ndjson(path: str, **sections: DataFrame) -> None:
    tagged_rows(**sections).select("body").write.mode("overwrite").text(path)


def write_csv(path: str, **sections: DataFrame) -> None:
    """One folder a section, with a header."""
    for tag, d in sections.items():
        d.write.mode("overwrite").option("header", True).csv(f"{path}/{tag}")


def json_report(summary: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON report a key: its summary and its sorted component changes."""
    changes = components.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in components.columns if c not in keys]))).alias("components"))
    joined = summary.join(changes, keys, "left")
    return joined.select(*keys, F.to_json(F.struct(F.struct(*[c for c in summary.columns]).alias("summary"), F.coalesce("components", F.array()).alias("components"))).alias("report"))


def sarif(results: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 run a document from ``sbom_id, rule_id, severity, message``."""
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    item = F.struct(F.col("rule_id").alias("ruleId"), F.coalesce(levels[F.lower("severity")], F.lit("note")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"))
    runs = results.groupBy("sbom_id").agg(F.array_sort(F.collect_list(item)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
    driver = F.struct(F.lit("bomloom").alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return runs.select("sbom_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", " ")


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table (for reports of bounded size)."""
    cells = rows.select(*[F.coalesce(escape_markdown_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns])
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in cells.collect()])
