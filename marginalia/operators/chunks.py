"""Documents to chunks: validation, planning, materialisation and the check of a plan's rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import errors
from marginalia.functions import text as T
from marginalia.operators.planner import ChunkingConfig, Planner
from marginalia.operators.scan import boundaries
from marginalia.runtime import spread
from marginalia.schemas import FILE_TYPES

#: A strategy gives the spans of a text.
Strategy = Callable[[str, ChunkingConfig], list[tuple[int, int]]]


def structural(text: str, config: ChunkingConfig) -> list[tuple[int, int]]:
    """The strategy that prefers structural boundaries."""
    return Planner(text, *boundaries(text), config).spans()


def document_error() -> Column:
    """The first thing wrong with a parsed document, or null."""
    text, count = F.col("extracted_text"), "invalid_document"
    return errors.first_error(
        (T.has_content(F.col("filename")), count, "filename is blank"),
        (F.col("file_type").isin(*FILE_TYPES), count, "file_type is unknown"),
        (F.col("page_count").isNull() | (F.col("page_count") >= 0), count, "page_count is negative"),
        ((F.col("word_count") >= 0) & (F.col("character_count") >= 0), count, "a count is negative"),
        (T.has_content(text), "empty_text", "text has no content"),
        (F.col("character_count") == T.character_count(text), count, "character_count is not that of the text"),
        (F.col("word_count") == T.word_count(text), count, "word_count is not that of the text"),
    )


def plan(df: DataFrame, id_col: str, text_col: str, config: ChunkingConfig | None = None, strategy: Strategy = structural) -> DataFrame:
    """(id, chunk_index, start_char, end_char) of every text.

    ``config`` holds for all texts; without it the columns max_chars, overlap_chars and min_chunk_chars of each
    row do. Null and empty texts, and rows with an invalid configuration, have no spans. Narrow.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    sizes = [F.lit(None).cast("int")] * 3 if config else [F.col(c).cast("int") for c in ("max_chars", "overlap_chars", "min_chunk_chars")]
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(s.alias(f"s{k}") for k, s in enumerate(sizes))).where(F.length("text") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, index, start, end = [], [], [], []
            for i, (text, *own) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                try:
                    found = strategy(text, config or ChunkingConfig(*own))
                except errors.CHUNK["invalid_config"]:
                    continue
                for k, (a, b) in enumerate(found):
                    owner.append(i), index.append(k), start.append(a), end.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int32()) for x in (index, start, end))], names=["id", "chunk_index", "start_char", "end_char"])

    return rows.mapInArrow(run, f"id {id_type}, chunk_index int, start_char int, end_char int").withColumnRenamed("id", id_col)


def _spans_array(df: DataFrame, config: ChunkingConfig | None, strategy: Strategy) -> DataFrame:
    """``df`` with the spans of its ``extracted_text`` as an array, so that no join is needed to cut it."""
    sizes = [F.lit(None).cast("int")] * 3 if config else [F.col(c).cast("int") for c in ("max_chars", "overlap_chars", "min_chunk_chars")]

    @F.pandas_udf("array<struct<start_char:int,end_char:int>>")
    def spans(texts, a, b, c):  # type: ignore[no-untyped-def]
        import pandas as pd

        whole = lambda x: None if x is None or x != x else int(x)
        found = []
        for text, *own in zip(texts, a, b, c):
            try:
                found.append([{"start_char": x, "end_char": y} for x, y in strategy(text, config or ChunkingConfig(*map(whole, own)))] if text else [])
            except errors.CHUNK["invalid_config"]:
                found.append(None)
        return pd.Series(found)

    return df.withColumn("spans", spans("extracted_text", *sizes))


def chunk(documents: DataFrame, config: ChunkingConfig | None = None, strategy: Strategy = structural, strict: bool = False) -> DataFrame:
    """Chunks of parsed documents in the DOCUMENT_CHUNK schema, with an ``error`` column.

    A document that isn't valid gives one row with its filename and the error, all else null; with ``strict`` it
    raises instead and there is no error column. Extra columns are not read. ``config`` as in ``plan``.
    """
    keep = ["filename", "file_type", "extracted_text", "page_count", "word_count", "character_count", "metadata"]
    more = [] if config else ["max_chars", "overlap_chars", "min_chunk_chars"]
    rows = spread(documents.select(*keep, *more)).withColumn("error", document_error())
    if strict:
        rows = errors.strictly(rows).withColumn("error", F.lit(None).cast("struct<code:string,message:string>"))
    valid = F.col("error").isNull()
    rows = _spans_array(rows.withColumn("extracted_text", F.when(valid, F.col("extracted_text"))), config, strategy)
    rows = rows.withColumn("print", F.when(valid, T.fingerprint(F.col("filename"), F.col("file_type"), F.col("extracted_text"))))
    rows = rows.select("*", F.posexplode_outer("spans").alias("chunk_index", "span"))
    # A valid text without spans has an invalid configuration.
    bad = F.struct(F.lit("invalid_config").alias("code"), F.lit("sizes of the row are no configuration").alias("message"))
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("span").isNull(), bad)))
    text = F.expr("substring(extracted_text, span.start_char + 1, span.end_char - span.start_char)")
    nested = F.when(F.col("span").isNotNull(), F.struct(F.col("file_type").alias("source_file_type"), F.col("metadata").alias("source_metadata")))
    made = rows.withColumn("text", text).select(
        F.when(F.col("span").isNotNull(), T.chunk_id(F.col("print"), F.col("span.start_char"), F.col("span.end_char"))).alias("chunk_id"),
        F.col("filename").alias("document_filename"),
        "chunk_index",
        "text",
        F.col("span.start_char").alias("start_char"),
        F.col("span.end_char").alias("end_char"),
        F.when(F.col("span").isNotNull(), T.word_count(F.col("text"))).alias("word_count"),
        T.character_count(F.col("text")).alias("character_count"),
        nested.alias("metadata"),
        "error",
    )
    return made.drop("error") if strict else made


def invariants(spans: DataFrame, lengths: DataFrame, id_col: str, config: ChunkingConfig) -> DataFrame:
    """(id, rule): the rules that stored spans (id, chunk_index, start_char, end_char) of texts of length n break."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    rows = spans.join(lengths.select(id_col, "n"), id_col)
    rows = rows.withColumns({"start_before": F.lag("start_char").over(w), "end_before": F.lag("end_char").over(w), "last": F.lead("start_char").over(w).isNull()})
    start, end, size = F.col("start_char"), F.col("end_char"), F.col("end_char") - F.col("start_char")
    most = F.when(F.col("last"), config.max_chars + config.least).otherwise(config.max_chars)
    first = F.col("start_before").isNull()
    rules = {
        "cover": (first & (start != 0)) | (F.col("last") & (end != F.col("n"))),
        "range": (start < 0) | (end <= start) | (end > F.col("n")),
        "size": size > most,
        "progress": start <= F.col("start_before"),
        "gap": start > F.col("end_before"),
        "end": end <= F.col("end_before"),
        "contribution": (end > F.col("end_before")) & (end - F.col("end_before") < config.least),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())), lambda r: r.isNotNull())
    return rows.select(id_col, F.explode(broken).alias("rule")).distinct()
