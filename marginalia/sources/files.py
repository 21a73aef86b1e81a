"""Files to parsed documents: listing and checks of uploads, and a parser for each format.

Checks of names and sizes read no content: ``binaryFile`` leaves out the bytes when only path and length are selected.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import errors
from marginalia.functions import text as T
from marginalia.sources import docx

# What may be uploaded, and how large.
EXTENSIONS = (".docx", ".md", ".pdf", ".txt")
MAX_BYTES = 52_428_800
CONTENT_TYPES = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".md": "text/markdown", ".txt": "text/plain"}
_ERROR = "struct<code:string,message:string>"


def safe_name(name: Column) -> Column:
    """The last part of a path with slashes of either kind."""
    return F.element_at(F.split(F.rtrim(F.translate(name, "\\", "/"), F.lit("/")), "/"), -1)


def suffix(name: Column) -> Column:
    """The lower-case suffix with its dot; empty for names without one, as '.pdf' is."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)\z|\A\.+[^.].*(\.[^.]+)\z", 1))


def name_error(name: Column) -> Column:
    """The first thing wrong with an upload's name, or null."""
    safe = safe_name(name)
    return errors.first_error(
        (name.isNotNull() & (name != ""), "upload_validation", "a file has no name"),
        (~safe.isin("", ".", "..") & ~F.contains(safe, F.lit("\0")), "upload_validation", "a name is invalid"),
        (suffix(safe).isin(*EXTENSIONS), "unsupported_type", "allowed extensions: " + ", ".join(EXTENSIONS)),
    )


def size_error(size: Column, most: int = MAX_BYTES) -> Column:
    """An error for a file above the greatest size, which itself is allowed."""
    return errors.first_error((size <= most, "upload_too_large", f"above {most} bytes"))


def stored_names(df: DataFrame, batch: list[str], order: list[str], name_col: str) -> DataFrame:
    """``df`` with ``stored_name``: the 1-based place in the batch in three digits or more, '_' and the safe name."""
    place = F.row_number().over(Window.partitionBy(*batch).orderBy(*order)).cast("string")
    return df.withColumn("stored_name", F.concat(F.lpad(place, F.greatest(F.length(place), F.lit(3)), "0"), F.lit("_"), safe_name(F.col(name_col))))


def check_uploads(df: DataFrame, batch: list[str], name_col: str = "filename", size_col: str = "file_size", most: int = MAX_BYTES) -> DataFrame:
    """``df`` with ``error`` of each file and ``accepted``: whether the whole batch is, as one failure rejects all."""
    error = F.coalesce(name_error(F.col(name_col)), size_error(F.col(size_col), most))
    rows = df.withColumn("error", error)
    return rows.withColumn("accepted", F.max(F.col("error").isNotNull()).over(Window.partitionBy(*batch)) == F.lit(False))


def batches(df: DataFrame) -> DataFrame:
    """Upload batches in the UPLOAD_BATCH schema from files (upload_id, file_no, ...); the batch's time is its last file's."""
    item = F.struct("file_no", "filename", "content_type", "file_size", "upload_timestamp", "status")
    lists = df.groupBy("upload_id").agg(F.max("upload_timestamp").alias("upload_timestamp"), F.array_sort(F.collect_list(item)).alias("files"))
    return lists.select("upload_id", "upload_timestamp", F.lit("uploaded").alias("status"), F.transform("files", lambda f: f.dropFields("file_no")).alias("files"))


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path) of the files of length 0, which a scan passes over; they are in the listing that the driver made for it and holds anyway."""
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return listed.join(files.select(plain(F.col("path")).alias("_seen")), plain(F.col("path")) == F.col("_seen"), "left_anti")


def ingest(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Files below ``path`` as an upload batch: one row a file, with its error; content isn't read.

    A folder without files gives one row without a path, whose error says that a batch holds at least one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    none = _empty_files(spark, files).select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    files = files.unionByName(none)
    if files.isEmpty():
        error = F.struct(F.lit("upload_validation").alias("code"), F.lit("a batch holds at least one file").alias("message"))
        files = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    else:
        error = F.lit(None).cast(_ERROR)
    name = safe_name(F.col("path"))
    types = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    rows = files.select("path", name.alias("filename"), types[suffix(name)].alias("content_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("upload_timestamp"))
    return rows.withColumn("status", F.lit("uploaded")).withColumn("error", F.coalesce(error, name_error(F.col("filename")), size_error(F.col("file_size"), most)))


PdfReader = Callable[[bytes], tuple[str, int, dict[str, str]]]


def pdf_library() -> PdfReader | None:
    """A reader of PDF files by an installed library, or None if there is none."""
    if importlib.util.find_spec("pymupdf") is None:
        return None

    def read(content: bytes) -> tuple[str, int, dict[str, str]]:
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as pdf:
            if pdf.needs_pass:
                raise ValueError("a password is needed")
            return "\n".join(page.get_text("text") for page in pdf), pdf.page_count, {k: str(v) for k, v in pdf.metadata.items() if v not in (None, "")}

    return read


_PARSED = f"extracted_text string, page_count int, metadata map<string,string>, error {_ERROR}"


def _binary(rows: DataFrame, kind: str, read: PdfReader | None) -> DataFrame:
    """Parse files of a binary format with ``read``, file by file in Arrow batches."""
    code = f"{kind}_parsing"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("extracted_text", pa.string()), ("page_count", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])
        for batch in batches:
            found = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = {"path": path, "extracted_text": None, "page_count": None, "metadata": None, "error": None}
                try:
                    if read is None:
                        raise ValueError("no library for this format is installed")
                    text, pages, properties = read(content)
                    row |= {"extracted_text": text, "page_count": pages, "metadata": list(properties.items())}
                except Exception as e:  # whatever a damaged file makes the reader raise
                    row["error"] = {"code": code, "message": f"{type(e).__name__}: {e}"[:500]}
                found.append(row)
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.select("path", "content").mapInArrow(run, f"path string, {_PARSED}")


def parse(spark: SparkSession, path: str, pdf: PdfReader | None = None, strict: bool = False) -> DataFrame:
    """Files below ``path`` as parsed documents in the PARSED_DOCUMENT schema, with ``error``.

    Text and Markdown are strict UTF-8 kept as they are, but for one byte order mark; DOCX is read with the
    standard library; PDF with ``pdf`` or an installed library. Empty files and texts without content are errors. With
    ``strict`` the first error raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none = _empty_files(spark, files).select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    files = files.unionByName(none).withColumn("filename", safe_name(F.col("path"))).withColumn("suffix", suffix(F.col("filename")))
    fine = F.lit(None).cast(_ERROR)
    known = files.where(F.col("suffix").isin(*EXTENSIONS) & (F.col("length") > 0))
    plain = known.where(F.col("suffix").isin(".txt", ".md"))
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), r"\A\x{FEFF}", ""))
    text = plain.select(
        "path",
        decoded.alias("extracted_text"),
        F.lit(None).cast("int").alias("page_count"),
        F.expr("cast(map() AS map<string,string>)").alias("metadata"),
        F.when(decoded.isNull(), F.struct(F.lit("text_decoding").alias("code"), F.lit("not UTF-8").alias("message"))).otherwise(fine).alias("error"),
    )
    word = _binary(known.where("suffix = '.docx'"), "docx", lambda content: (lambda t: (t[0], None, t[1]))(docx.read(content)))  # type: ignore[arg-type, return-value]
    portable = _binary(known.where("suffix = '.pdf'"), "pdf", pdf or pdf_library())
    unknown = F.struct(F.lit("unsupported_file_type").alias("code"), F.lit("no parser for this extension").alias("message"))
    empty = F.struct(F.lit("empty_document").alias("code"), F.lit("the file is empty").alias("message"))
    failed = files.where(~F.col("suffix").isin(*EXTENSIONS) | (F.col("length") == 0)).select(
        "path", F.lit(None).cast("string").alias("extracted_text"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("map<string,string>").alias("metadata"),
        F.when(F.col("suffix").isin(*EXTENSIONS), empty).otherwise(unknown).alias("error"),
    )
    rows = text.unionByName(word).unionByName(portable).unionByName(failed)
    blank = F.struct(F.lit("empty_document").alias("code"), F.lit("the text has no content").alias("message"))
    error = F.coalesce("error", F.when(~T.has_content(F.col("extracted_text")), blank))
    name = safe_name(F.col("path"))
    rows = rows.withColumn("error", error).withColumn("extracted_text", F.when(F.col("error").isNull(), F.col("extracted_text"))).select(
        name.alias("filename"),
        F.substring(suffix(name), 2, 10).alias("file_type"),
        "extracted_text",
        "page_count",
        T.word_count(F.col("extracted_text")).alias("word_count"),
        T.character_count(F.col("extracted_text")).alias("character_count"),
        "metadata",
        "error",
    )
    return errors.strictly(rows) if strict else rows
