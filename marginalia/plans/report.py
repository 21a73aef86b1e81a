"""Reports synthesised from knowledge objects, and their rendering as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import errors
from marginalia.runtime import stage
from marginalia.schemas import FINDING, SECTION, TIMELINE_EVENT

# The texts of a report.
TITLE = "Research Report"
SUMMARY = "Research report generated from %d extracted knowledge objects."
DISTINCT = {"entities": "important_entities", "definitions": "important_definitions", "metrics": "important_metrics", "refs": "refs"}


def numbered(df: DataFrame, order: list[str], by: list[str], out: str = "number", parts: int | None = None) -> DataFrame:
    """``df`` with the 1-based number of each row within ``by`` in the order of ``order``.

    With ``by`` empty the rows are range-partitioned and written with the number of their range, then numbered within
    each range and shifted by the rows of the ranges before, so that no task sees all rows; ``order`` should be unique.
    """
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def _others(order: list[str], by: list[str], id_col: str) -> list[str]:
    return [o for o in order if o not in by and o != id_col]


def distinct_values(knowledge: DataFrame, order: list[str], by: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(by, kind, value, number): values of the collections that a report lists once, in order of first appearance.

    The order is that of ``order`` among objects, then the place in the list. Comparison is exact.
    """
    keyed = knowledge.select(*by, F.struct(*_others(order, by, id_col), id_col).alias("_at"), *DISTINCT)
    rows = keyed.select(*by, "_at", F.explode(F.create_map(*(x for c in DISTINCT for x in (F.lit(c), F.col(c))))).alias("kind", "list"))
    rows = rows.select(*by, "_at", "kind", F.posexplode("list").alias("pos", "value"))
    firsts = rows.groupBy(*by, "kind", "value").agg(F.min(F.struct("_at", "pos")).alias("first"))
    number = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("first"))
    return firsts.select(*by, "kind", "value", number.cast("long").alias("number"))


def findings(knowledge: DataFrame, order: list[str], by: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(by, number, title, description, chunk_id): one for each fact, numbered over all; repeated facts stay."""
    rows = knowledge.select(*by, *_others(order, by, id_col), F.col(id_col).alias("chunk_id"), F.posexplode("facts").alias("pos", "description"))
    rows = numbered(rows, [*(o for o in order if o != id_col), "chunk_id", "pos"], by)
    return rows.select(*by, "number", F.format_string("Finding %d", "number").alias("title"), "description", "chunk_id")


def timeline(knowledge: DataFrame, order: list[str], by: list[str], id_col: str = "chunk_id") -> DataFrame:
    """(by, number, date, description, chunk_id): one for each date in source order, which isn't that of time."""
    rows = knowledge.select(*by, *_others(order, by, id_col), F.col(id_col).alias("chunk_id"), F.posexplode("dates").alias("pos", "date"))
    rows = numbered(rows, [*(o for o in order if o != id_col), "chunk_id", "pos"], by)
    return rows.select(*by, "number", "date", F.format_string("Extracted date: %s.", "date").alias("description"), "chunk_id")


def synthesize(knowledge: DataFrame, order: list[str], by: list[str], id_col: str = "chunk_id") -> DataFrame:
    """One report for each value of ``by`` (e.g. the document), in the REPORT schema; ``order`` orders its objects.

    A report is one row, so it holds what one document or a chosen set of chunks says. Groups without any
    item have empty lists. Null collections count as empty.
    """
    empty = F.expr("cast(array() AS array<string>)")
    objects = knowledge.select(*by, *_others(order, by, id_col), F.col(id_col), *(F.coalesce(F.col(c), empty).alias(c) for c in ("entities", "facts", "definitions", "metrics", "dates", "refs")))
    # Everything is put together from the group's sorted objects: one shuffle.
    lists = objects.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*_others(order, by, id_col), id_col, "entities", "facts", "definitions", "metrics", "dates", "refs"))).alias("o"))
    once = lambda c: F.array_distinct(F.flatten(F.transform("o", lambda x: x[c])))
    facts = F.flatten(F.transform("o", lambda x: F.transform(x["facts"], lambda f: F.struct(x[id_col].alias("id"), f.alias("v")))))
    dates = F.flatten(F.transform("o", lambda x: F.transform(x["dates"], lambda f: F.struct(x[id_col].alias("id"), f.alias("v")))))
    lists = lists.withColumn("f", facts).withColumn("d", dates)
    found = F.transform("f", lambda x, i: F.struct(F.format_string("Finding %d", i + 1).alias("title"), x["v"].alias("description"), F.array(x["id"]).alias("supporting_chunk_ids")))
    events = F.transform("d", lambda x: F.struct(x["v"].alias("date"), F.format_string("Extracted date: %s.", x["v"]).alias("description"), F.array(x["id"]).alias("supporting_chunk_ids")))
    return lists.select(
        *by,
        F.lit(TITLE).alias("title"),
        F.format_string(SUMMARY, F.size("o")).alias("executive_summary"),
        found.cast(f"array<{FINDING}>").alias("findings"),
        once("entities").alias("important_entities"),
        once("definitions").alias("important_definitions"),
        once("metrics").alias("important_metrics"),
        events.cast(f"array<{TIMELINE_EVENT}>").alias("timeline"),
        once("refs").alias("refs"),
        F.expr(f"cast(array() AS array<{SECTION}>)").alias("sections"),
    )


def report_error() -> Column:
    """The first thing wrong with a report, or null: nulls in its lists, repeated entities or references, ids that are no UUIDs."""
    code = "invalid_report"
    checks = [(F.col(c).isNotNull(), code, f"{c} is null") for c in ("title", "executive_summary")]
    for c in ("findings", "important_entities", "important_definitions", "important_metrics", "timeline", "refs", "sections"):
        checks.append((F.col(c).isNotNull() & ~F.exists(F.col(c), lambda x: x.isNull()), code, f"{c} is no complete list"))
    for c in ("important_entities", "refs"):
        checks.append((F.size(F.array_distinct(c)) == F.size(c), code, f"{c} repeats a value"))
    uuid = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    for c in ("findings", "timeline"):
        checks.append((F.forall(F.col(c), lambda x: F.forall(x["supporting_chunk_ids"], lambda i: F.coalesce(i.rlike(uuid), F.lit(False)))), code, f"{c} name a chunk that is no UUID"))
    return errors.first_error(*checks)


def _bullets(heading: str, lines: Column) -> Column:
    return F.when(F.size(lines) == 0, F.lit(f"## {heading}")).otherwise(F.concat(F.lit(f"## {heading}\n\n"), F.array_join(lines, "\n")))


def markdown() -> Column:
    """A report's row as Markdown: fixed order of blocks, a blank line between them, one line feed at the end."""
    plain = lambda c: F.transform(c, lambda v: F.concat(F.lit("- "), v))
    bold = lambda c, a, b: F.transform(c, lambda v: F.concat(F.lit("- **"), v[a], F.lit("**: "), v[b]))
    fixed = F.array(
        F.concat(F.lit("# "), F.col("title")),
        F.concat(F.lit("## Executive Summary\n\n"), F.col("executive_summary")),
        _bullets("Key Findings", bold("findings", "title", "description")),
        _bullets("Important Entities", plain("important_entities")),
        _bullets("Definitions", plain("important_definitions")),
        _bullets("Metrics", plain("important_metrics")),
        _bullets("Timeline", bold("timeline", "date", "description")),
        _bullets("References", plain("refs")),
    )
    more = F.transform("sections", lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["content"]))
    blocks = F.transform(F.concat(fixed, more), lambda b: F.rtrim(b, F.lit("\n")))
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))


def render(reports: DataFrame, strict: bool = False) -> DataFrame:
    """``reports`` with ``markdown`` and ``error``: reports that aren't valid have no Markdown but an error, or raise."""
    rows = reports.withColumn("error", report_error())
    rows = rows.withColumn("markdown", F.when(F.col("error").isNull(), markdown()))
    return errors.strictly(rows) if strict else rows


