"""Lines, structural groups and cut boundaries of documents, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.dialect import N, S, strip
from marginalia.functions.text import title_case, words

BULLET = rf"(?U)^{S}*(?:[-*+•]{S}+|\d+[.)]{S}+)"
ATX_HEADING = rf"^{S}{{0,3}}#{{1,6}}{S}+{N}"
NUMBERED = rf"(?U)^{S}*\d+(?:\.\d+)*[.)]?{S}+{N}"
# The limits of a heading without marks.
HEADING_CHARS, HEADING_WORDS, NO_HEADING_END = 120, 12, ".?!;:"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, start, end, next_start, line): lines between line feeds, without one trailing carriage return.

    ``end`` excludes the line feed. A null or empty text has no lines; a line feed at the end opens no new line.
    """
    pieces = F.split(F.col(text_col), "\n", -1)
    rows = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.length(text_col).alias("n"), F.posexplode(pieces).alias("line_no", "raw"))
    before = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int")
    rows = rows.withColumn("start", start).where("start < n")
    end = (F.col("start") + F.length("raw")).cast("int")
    line = F.when(F.endswith("raw", F.lit("\r")), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    return rows.select("id", "line_no", "start", end.alias("end"), F.least(end + 1, F.col("n")).cast("int").alias("next_start"), line.alias("line"))


def _kind(line: Column, next_blank: Column) -> Column:
    text = strip(line)
    short = (F.length(text) <= HEADING_CHARS) & (F.size(words(text)) <= HEADING_WORDS)
    bare = short & ~F.right(text, F.lit(1)).isin(*NO_HEADING_END) & next_blank & (line.rlike(NUMBERED) | title_case(text))
    return F.when(text == "", "blank").when(line.rlike(ATX_HEADING), "heading").when(line.rlike(BULLET), "list").when(bare, "heading").otherwise("paragraph")


def kinds(df: DataFrame) -> DataFrame:
    """``lines`` with a ``kind``: blank, heading, list (a bullet) or paragraph."""
    w = Window.partitionBy("id").orderBy("line_no")
    next_blank = F.coalesce(F.lead(strip(F.col("line")) == "").over(w), F.lit(False))
    return df.withColumn("kind", _kind(F.col("line"), next_blank))


def groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, start, end, kind, item_starts): structural groups; a heading goes with the content after it.

    A heading is a group; runs of bullets and of plain lines are lists and paragraphs; blank lines part and are
    dropped; a heading before a list or paragraph joins it as ``heading_with_content``.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    rows = kinds(lines(df, id_col, text_col))
    new = (F.col("kind") == "heading") | ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))
    rows = rows.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("kind <> 'blank'")
    items = F.when(F.first("kind") == "list", F.array_sort(F.collect_list("start"))).otherwise(F.expr("cast(array() AS array<int>)"))
    raw = rows.groupBy("id", "island").agg(F.first("kind").alias("kind"), F.min("start").alias("start"), F.max("next_start").alias("end"), items.alias("item_starts"))
    g = Window.partitionBy("id").orderBy("island")
    joins = (F.col("kind") == "heading") & F.lead("kind").over(g).isin("paragraph", "list")
    raw = raw.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("taken", F.coalesce(F.lag("joins").over(g), F.lit(False)))
    found = raw.select(
        "id",
        "start",
        "island",
        "taken",
        F.when(F.col("joins"), F.lead("end").over(g)).otherwise(F.col("end")).alias("end"),
        F.when(F.col("joins"), "heading_with_content").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("joins"), F.lead("item_starts").over(g)).otherwise(F.col("item_starts")).alias("item_starts"),
    ).where("NOT taken")
    return found.select(F.col("id").alias(id_col), (F.row_number().over(g) - 1).alias("ord"), "start", "end", "kind", "item_starts")


def boundaries(groups_: DataFrame, lengths: DataFrame, id_col: str) -> DataFrame:
    """(id, hard, soft): sorted offsets where a text may be cut, from its groups and its length (id, n)."""
    own = groups_.groupBy(id_col).agg(
        F.collect_list(F.when(F.col("ord") > 0, F.col("start"))).alias("starts"),
        F.flatten(F.collect_list(F.slice("item_starts", 2, 1_000_000_000))).alias("items"),
    )
    none = F.expr("cast(array() AS array<int>)")
    hard = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("starts", none), F.array(F.col("n").cast("int")))))
    return lengths.join(own, id_col, "left").select(id_col, hard.alias("hard"), F.array_sort(F.array_distinct(F.coalesce("items", none))).alias("soft"))


def last_between(positions: Column, above: Column, upto: Column) -> Column:
    """The greatest of ``positions`` above ``above`` and not above ``upto``; null if there is none."""
    return F.array_max(F.filter(positions, lambda p: (p > above) & (p <= upto)))


def first_between(positions: Column, least: Column, upto: Column) -> Column:
    """The least of ``positions`` from ``least`` to ``upto``; null if there is none."""
    return F.array_min(F.filter(positions, lambda p: (p >= least) & (p <= upto)))


def nearest(positions: Column, target: Column, least: Column, below: Column) -> Column:
    """The one of ``positions`` from ``least`` to before ``below`` that is nearest to ``target``, of two the smaller; null if there is none."""
    inside = F.filter(positions, lambda p: (p >= least) & (p < below))
    return F.array_min(F.transform(inside, lambda p: F.struct(F.abs(p - target).alias("distance"), p.alias("at"))))["at"]
