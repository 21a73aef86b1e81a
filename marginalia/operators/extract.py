"""Rule-based knowledge of chunks: entities, facts, definitions, metrics, dates and references, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.functions import text as T
from marginalia.functions.dialect import S, W
from marginalia.schemas import COLLECTIONS

# The patterns that the rules are made of.
TITLE_WORD = r"[A-Z][a-z]+(?:'[A-Z][a-z]+)?(?:-[A-Z][a-z]+)*"
TITLE_ENTITY = rf"(?<![\w'-]){TITLE_WORD}(?:{S}+{TITLE_WORD})+(?![\w'-])"
CAPS_ENTITY = r"(?<![A-Z0-9])[A-Z]{2,}(?:-[A-Z]{2,})?(?![A-Z0-9])"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
YEAR = r"(?:1[5-9]\d{2}|2[01]\d{2})"
# The look-aheads at the start of the next two only save time: nothing else can begin a match.
DATE = rf"(?U)(?i)(?=[\dJFMASONDſ])(?:(?<!\d)\d{{4}}-\d{{2}}-\d{{2}}(?!\d)|\b(?:{MONTHS}){S}+{YEAR}\b|(?<![\d-]){YEAR}(?![\d-]))"
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
UNITS = "kg|g|mg|km|m|cm|mm|mi|ft|lb|lbs|oz|ml|l|ms|s|min|h|hr|hrs|hz|khz|mhz|ghz|kb|mb|gb|tb"
METRIC = rf"(?U)(?i)(?=[$\d])(?<![\w.])(?:\${NUMBER}|{NUMBER}%|{NUMBER}{S}+(?:{UNITS})\b|{NUMBER})(?!\w)"
LINK = rf"\[[^\]\r\n]+\]\([^{W}()]+\)"
URL = rf"https?://[^{W}<>\])]+(?<![.,;:!?])"
DEFINITION = rf"(?U)(?iu)(?d)^{S}*.+?{S}+(?:is|refers{S}+to|means){S}+.+?\.{S}*\z"
FACT_WORDS = 3


def reference_spans(text: Column) -> Column:
    """Markdown links, and URLs apart from them, in order of place."""
    return T.let(T.spans(text, LINK), lambda links: F.array_sort(F.concat(links, T.apart(T.spans(text, URL), links))))


def date_spans(text: Column, references: Column) -> Column:
    return T.apart(T.spans(text, DATE), references)


def metric_spans(text: Column, reserved: Column) -> Column:
    return T.apart(T.spans(text, METRIC), reserved)


def entities(text: Column) -> Column:
    """Title-case names and runs of capitals, the first of equal ones."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?U)({TITLE_ENTITY}|{CAPS_ENTITY})"), F.lit(1)))


def facts(sentences: Column) -> Column:
    """Sentences of three words or more; repeated ones stay."""
    return F.filter(sentences, lambda s: T.word_count(s) >= FACT_WORDS)


def definitions(sentences: Column) -> Column:
    """Sentences that say what something is, refers to or means."""
    return F.filter(sentences, lambda s: s.rlike(DEFINITION))


def _values(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["value"])


def knowledge(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Knowledge objects of the texts, in the KNOWLEDGE_OBJECT schema with ``id_col`` for chunk_id; confidence is 1.

    A null text has null collections, an empty one empty ones. Narrow; columns other than the two are not read.
    """
    text = F.col("text")
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = rows.withColumn("sentences", T.sentences(text)).withColumn("ref_spans", reference_spans(text))
    rows = rows.withColumn("dated", date_spans(text, F.col("ref_spans")))
    rows = rows.withColumn("measured", metric_spans(text, F.concat("dated", "ref_spans")))
    return rows.select(
        id_col,
        entities(text).alias("entities"),
        facts(F.col("sentences")).alias("facts"),
        definitions(F.col("sentences")).alias("definitions"),
        _values(F.col("measured")).alias("metrics"),
        _values(F.col("dated")).alias("dates"),
        _values(F.col("ref_spans")).alias("refs"),
        F.lit(1.0).alias("confidence"),
    )


def items(knowledge_: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, kind, pos, value): the collections of knowledge objects in long form."""
    pairs = F.create_map(*(x for c in COLLECTIONS for x in (F.lit(c), F.col(c))))
    lists = knowledge_.select(id_col, F.explode(pairs).alias("kind", "list"))
    return lists.select(id_col, "kind", F.posexplode("list").alias("pos", "value"))


def chunk_error() -> Column:
    """The first thing wrong with a chunk before extraction, or null."""
    text, code = F.col("text"), "extraction"
    uuid = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    return errors.first_error(
        (F.col("chunk_id").rlike(uuid), code, "chunk_id is no UUID"),
        (T.has_content(F.col("document_filename")), code, "document_filename is blank"),
        (F.col("chunk_index") >= 0, code, "chunk_index is negative"),
        (T.has_content(text), code, "text has no content"),
        ((F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")), code, "offsets are invalid"),
        (F.col("end_char") - F.col("start_char") == F.length(text), code, "offsets are not those of the text"),
        (F.col("character_count") == F.length(text), code, "character_count is not that of the text"),
        (F.col("word_count") == T.word_count(text), code, "word_count is not that of the text"),
    )


def knowledge_error() -> Column:
    """The first thing wrong with a knowledge object, or null."""
    code = "invalid_knowledge"
    lists = [(F.col(c).isNotNull() & ~F.exists(F.col(c), lambda x: x.isNull()), code, f"{c} is no list of strings") for c in COLLECTIONS]
    c = F.col("confidence")
    return errors.first_error((F.col("chunk_id").isNotNull(), code, "chunk_id is null"), *lists, (~F.isnan(c) & c.between(0, 1), code, "confidence is not from 0 to 1"))


def process(chunks: DataFrame, provider=None, strict: bool = False) -> DataFrame:  # type: ignore[no-untyped-def]
    """Knowledge objects of chunks, one for each; repeated chunks are processed again.

    ``provider`` (DataFrame of chunks to DataFrame of knowledge objects with an optional ``error``) defaults to the
    rules. Chunks that fail a check give a row with their id and the ``error``; with ``strict`` they raise.
    """
    checked = chunks.withColumn("error", chunk_error())
    good = checked.where("error IS NULL").drop("error")
    made = provider(good) if provider else knowledge(good, "chunk_id", "text")
    own = F.col("error") if "error" in made.columns else F.lit(None).cast("struct<code:string,message:string>")
    made = made.select("chunk_id", *COLLECTIONS, "confidence", F.coalesce(own, knowledge_error()).alias("error"))
    bad = checked.where("error IS NOT NULL").select(*(F.col(f.name) if f.name in ("chunk_id", "error") else F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema))
    result = made.unionByName(bad)
    return errors.strictly(result) if strict else result


