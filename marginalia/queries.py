"""Queries of the core operators over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.functions import text as T
from marginalia.functions.dialect import WS_CHARS
from marginalia.operators import chunks, extract, structure, timestamps
from marginalia.operators.planner import ChunkingConfig
from marginalia.plans import report
from marginalia.providers import completion
from marginalia.runtime import health, spread, stage, table
from marginalia.schemas import ANSWER_COLLECTIONS, COLLECTIONS
from marginalia.sources import files

# ---------------------------------------------------------------- inputs


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "parsed_documents").select("parsed_id", "extracted_text"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A note about every order, rendered from its columns, so that SQL can read the columns instead of the note."""
    price = F.format_number("o_totalprice", 2)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    note = F.concat(
        F.initcap("c_mktsegment"), F.lit(" Order Desk billed $"), price, F.lit(" on "), day, F.lit(". Invoice Ledger is a record of order. See http://shop.example/o/"),
        F.col("o_orderkey").cast("string"), F.lit(" and [order]("), F.lit("http://shop.example/p/"), F.col("o_custkey").cast("string"), F.lit(") for detail."),
    )
    orders, customers = spread(table(spark, d, "orders")), table(spark, d, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("key"), note.alias("text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks, those delivered again once."""
    return table(spark, d, "document_chunks").drop("loaded_at", "metadata").distinct()


def _knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge objects, those delivered again once, with their document and place in it."""
    objects = table(spark, d, "knowledge_objects").select("chunk_id", *COLLECTIONS, "confidence").distinct()
    return objects.join(_chunks(spark, d).select("chunk_id", "parsed_id", "chunk_index").distinct(), "chunk_id")


# ---------------------------------------------------------------- text functions


def t1_word_count(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.has_content(F.col("text")).alias("has_content"))


def t2_character_count(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.character_count(F.col("text")).alias("n_characters"))


def t3_lines(spark: SparkSession, d: str) -> DataFrame:
    found = structure.lines(_parsed(spark, d), "parsed_id", "extracted_text")
    return found.select(F.col("id").alias("parsed_id"), "line_no", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "next_start", F.sha2("line", 256).alias("line_hash"))


def t5_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = structure.kinds(structure.lines(_parsed(spark, d), "parsed_id", "extracted_text"))
    return found.groupBy(F.col("id").alias("parsed_id"), "kind").agg(F.count("*").alias("n_lines"))


def t8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def t9_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    parsed = spread(table(spark, d, "parsed_documents").select("parsed_id", "filename", "file_type", "extracted_text"))
    return parsed.select("parsed_id", T.fingerprint(F.col("filename"), F.col("file_type"), F.col("extracted_text")).alias("fingerprint"))


def t10_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("print"), F.length("text").alias("n")).where("n IS NOT NULL")
    return found.select("doc_id", T.chunk_id(F.col("print"), F.lit(0), F.col("n")).alias("chunk_id"))


def t11_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' metadata as JSON is flat without that of the source and nested with it; one level deeper, and damaged, it is neither."""
    own = F.to_json("metadata")
    rows = spread(table(spark, d, "document_chunks").select("chunk_id", own.alias("own"), F.concat(F.lit('{"a": '), own, F.lit("}")).alias("deep"), F.concat(own, F.lit("]")).alias("broken")).distinct())
    columns = {f"{name}_{kind}": T.json_metadata(F.col(name), kind == "nested") for name in ("own", "deep", "broken") for kind in ("plain", "nested")}
    return rows.select("chunk_id", *(c.alias(n) for n, c in columns.items()))


# ---------------------------------------------------------------- structure and chunks


def g1_groups(spark: SparkSession, d: str) -> DataFrame:
    found = structure.groups(_parsed(spark, d), "parsed_id", "extracted_text")
    return found.select("parsed_id", "ord", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "kind", F.size("item_starts").alias("n_items"))


def g3_boundaries(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    found = structure.boundaries(structure.groups(parsed, "parsed_id", "extracted_text"), parsed.select("parsed_id", F.length("extracted_text").alias("n")), "parsed_id")
    sides = [found.select("parsed_id", F.lit(side).alias("side"), F.explode(side).alias("at_char")) for side in ("hard", "soft")]
    return sides[0].unionByName(sides[1])


def _configured(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents with the sizes of their configuration, a table of fixed size."""
    documents = table(spark, d, "parsed_documents").withColumn("file_type", F.lower("file_type"))
    return documents.join(F.broadcast(table(spark, d, "chunking_configs")), "config_id")


def c5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Of the starts of a document's stored chunks the last and first on each side of its middle, and the nearest to it."""
    starts = _chunks(spark, d).groupBy("parsed_id").agg(F.collect_set("start_char").alias("starts"), F.max("end_char").alias("n"))
    middle = F.floor(F.col("n") / 2).cast("int")
    lookups = {"last_start": structure.last_between(F.col("starts"), F.lit(-1), middle), "first_start": structure.first_between(F.col("starts"), middle, F.col("n")), "nearest_start": structure.nearest(F.col("starts"), middle, F.lit(0), F.col("n"))}
    return starts.select("parsed_id", *(c.alias(k) for k, c in lookups.items()))


def c12_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunks.plan(_configured(spark, d), "parsed_id", "extracted_text")


def _unbroken(spark: SparkSession, d: str) -> DataFrame:
    """Every parsed document with a text as long as its own that has no place to cut, so that SQL can reckon its chunks."""
    rows = _configured(spark, d).where("length(extracted_text) > 0").withColumn("n", F.length("extracted_text"))
    return rows.withColumns({"extracted_text": F.expr("repeat('x', n)"), "filename": F.col("parsed_id"), "word_count": F.lit(1).cast("long"), "character_count": F.col("n").cast("long"), "file_type": F.lit("txt"), "page_count": F.lit(None).cast("int")})


def c12_unbroken(spark: SparkSession, d: str) -> DataFrame:
    return chunks.plan(_unbroken(spark, d), "parsed_id", "extracted_text")


def c16_unbroken(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.chunk(_unbroken(spark, d))
    return found.select("chunk_id", F.col("document_filename").alias("parsed_id"), "chunk_index", "start_char", "end_char", "word_count", "character_count", F.length("text").alias("n"), F.col("error.code").alias("error_code"))


def c12_lists(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a heading and a list of every order's items: heads stay with what follows, items stay whole."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("k"))
    text = F.concat(F.lit("# Items of it\n\n"), F.expr("repeat('- this item is as long as any\n', k)"))
    return chunks.plan(items.select("l_orderkey", text.alias("text")), "l_orderkey", "text", ChunkingConfig(100, 0))


def c15_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a plan of 800 and 80 characters that the stored chunks break, which have other sizes and defects."""
    spans = _chunks(spark, d).select("parsed_id", "chunk_index", "start_char", "end_char").distinct()
    lengths = table(spark, d, "parsed_documents").select("parsed_id", F.length("extracted_text").alias("n"))
    return chunks.invariants(spans, lengths, "parsed_id", ChunkingConfig(800, 80))


def c16_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.chunk(_configured(spark, d))
    return found.select("chunk_id", "document_filename", "chunk_index", "start_char", "end_char", "word_count", "character_count", F.col("error.code").alias("error_code"))


def c14_document_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "parsed_documents")).withColumn("error", chunks.document_error())
    return rows.select("parsed_id", F.col("error.code").alias("error_code"))


# ---------------------------------------------------------------- extraction


def k4_entities(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("key", F.posexplode(extract.entities(F.col("text"))).alias("pos", "value"))


def k7_dates(spark: SparkSession, d: str) -> DataFrame:
    spans = extract.date_spans(F.col("text"), extract.reference_spans(F.col("text")))
    return _notes(spark, d).select("key", F.explode(spans).alias("s")).select("key", F.col("s.start").alias("start_char"), F.col("s.value").alias("value"))


def k8_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _notes(spark, d).withColumn("r", extract.reference_spans(F.col("text"))).withColumn("t", extract.date_spans(F.col("text"), F.col("r")))
    return rows.select("key", F.explode(extract.metric_spans(F.col("text"), F.concat("t", "r"))).alias("s")).select("key", F.col("s.value").alias("value"))


def k9_references(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("key", F.posexplode(extract.reference_spans(F.col("text"))).alias("pos", "s")).select("key", "pos", F.col("s.value").alias("value"))


def k5_facts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(extract.facts(T.sentences(F.col("text")))).alias("pos", "fact"))


def k6_definitions(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(extract.definitions(T.sentences(F.col("text")))).alias("pos", "definition"))


def k1_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return extract.items(extract.knowledge(spread(_chunks(spark, d)), "chunk_id", "text"))


def k10_merged(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks' spans of each document, joined where they overlap or touch."""
    lists = _chunks(spark, d).groupBy("parsed_id").agg(F.collect_list(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("spans"))
    found = lists.select("parsed_id", F.explode(T.merged(F.col("spans"))).alias("s"))
    return found.select("parsed_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


def e1_chunk_errors(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).withColumn("error", extract.chunk_error()).select("chunk_id", F.col("error.message").alias("message"))


def e3_knowledge_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "knowledge_objects").select("chunk_id", *COLLECTIONS, "confidence").distinct().withColumn("error", extract.knowledge_error())
    return rows.select("chunk_id", F.col("error.message").alias("message"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers rendered from knowledge objects: right ones, and each kind of wrong one."""
    objects = table(spark, d, "knowledge_objects").select("chunk_id", *COLLECTIONS, "confidence").distinct().where(" AND ".join(f"{c} IS NOT NULL" for c in COLLECTIONS))
    lists = [F.col(c).alias(a) for a, c in zip(ANSWER_COLLECTIONS, COLLECTIONS)]
    whole = F.struct(*lists, "confidence")
    versions = {
        "right": F.to_json(whole),
        "missing": F.to_json(F.struct(*lists[1:], "confidence")),
        "extra": F.to_json(F.struct(*lists, "confidence", F.lit(1).alias("more"))),
        "range": F.to_json(F.struct(*lists, F.lit(1.5).alias("confidence"))),
        "broken": F.concat(F.to_json(whole), F.lit("}")),
        "bracket": F.concat(F.to_json(whole), F.lit("]")),
        "blank": F.lit(" "),
    }
    return reduce(DataFrame.unionByName, [objects.select("chunk_id", F.lit(k).alias("version"), v.alias("content"), F.lit(None).cast("string").alias("code")) for k, v in versions.items()])


def l5_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _responses(spark, d).withColumn("chunk_id", F.concat_ws("/", "chunk_id", "version"))
    found = completion.answers(rows.drop("version"))
    return found.select("chunk_id", F.col("error.code").alias("error_code"), F.size("entities").alias("n_entities"))


# ---------------------------------------------------------------- reports

_ORDER, _BY = ["chunk_index", "chunk_id"], ["parsed_id"]


def r2_distinct(spark: SparkSession, d: str) -> DataFrame:
    return report.distinct_values(_knowledge(spark, d), _ORDER, _BY)


def r3_findings(spark: SparkSession, d: str) -> DataFrame:
    return report.findings(_knowledge(spark, d), ["parsed_id", *_ORDER], [])


def r4_timeline(spark: SparkSession, d: str) -> DataFrame:
    return report.timeline(_knowledge(spark, d), _ORDER, _BY)


def r5_summary(spark: SparkSession, d: str) -> DataFrame:
    found = report.synthesize(_knowledge(spark, d), _ORDER, _BY)
    return found.select("parsed_id", "title", "executive_summary", F.size("findings").alias("n_findings"), F.size("important_entities").alias("n_entities"), F.size("refs").alias("n_refs"))


def r7_markdown(spark: SparkSession, d: str) -> DataFrame:
    found = report.render(report.synthesize(_knowledge(spark, d), _ORDER, _BY))
    return found.select("parsed_id", "markdown", F.col("error.code").alias("error_code"))


# ---------------------------------------------------------------- uploads


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files, each as it was first received."""
    first = table(spark, d, "uploads").groupBy("upload_id", "file_no")
    return first.agg(*(F.min_by(c, "received_at").alias(c) for c in ("filename", "content_type", "file_size", "upload_timestamp", "status")))


def s2_health(spark: SparkSession, d: str) -> DataFrame:
    return health(spark)


def s5_upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Names and sizes of every upload; with a limit of 40,000 bytes some batches are rejected as a whole."""
    found = files.check_uploads(_uploads(spark, d), ["upload_id"], most=40_000)
    status = F.when(F.col("error").isNotNull(), errors.http_status(F.col("error.code")))
    return found.select("upload_id", "file_no", F.col("error.code").alias("error_code"), status.alias("http_status"), "accepted")


def s7_stored_names(spark: SparkSession, d: str) -> DataFrame:
    return files.stored_names(_uploads(spark, d), ["upload_id"], ["file_no"], "filename").select("upload_id", "file_no", "stored_name", files.suffix(F.col("filename")).alias("suffix"))


def s9_batches(spark: SparkSession, d: str) -> DataFrame:
    found = files.batches(_uploads(spark, d))
    size = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["file_size"])
    return found.select("upload_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', upload_timestamp)").alias("at_us"), "status", F.size("files").alias("n_files"), size.alias("n_bytes"))


# ---------------------------------------------------------------- instants


def _instants(spark: SparkSession, d: str) -> DataFrame:
    events = timestamps.normalise_events(table(spark, d, "timeline_events"), "timeline", "event_id", "event_date", "report_id", "pos")
    return events.unionByName(timestamps.normalise_lists(table(spark, d, "knowledge_objects"), "knowledge", "chunk_id", "dates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("conform").select("kind", "record_key", "pos", "utc_us").distinct()


def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        t1_word_count, t2_character_count, t3_lines, t5_line_kinds, t8_sentences, t9_fingerprint, t10_chunk_ids, t11_metadata, g1_groups, g3_boundaries, c5_nearest, c12_spans, c12_unbroken, c12_lists, c16_unbroken, c14_document_errors, c15_invariants,
        c16_chunks, k1_knowledge, k4_entities, k5_facts, k6_definitions, k7_dates, k8_metrics, k9_references, k10_merged, e1_chunk_errors, e3_knowledge_errors, l5_answers, r2_distinct, r3_findings,
        r4_timeline, r5_summary, r7_markdown, s2_health, s5_upload_checks, s7_stored_names, s9_batches, p2_found, p2_readings,
    ]
    return {f.__name__: f for f in found}


# ---------------------------------------------------------------- SQL

_W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CHARS = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)
_SENTENCES = rf"""SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?s)(.*?\.)(?:[{_W}]|$)', 1), lambda s: trim(s, {_CHARS}))) AS sentence,
  generate_subscripts(regexp_extract_all(text, '(?s)(.*?\.)(?:[{_W}]|$)', 1), 1) AS n FROM documents"""
_LINES = """SELECT parsed_id, i - 1 AS line_no, raw, start_char, n FROM (
  SELECT *, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY parsed_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_char
  FROM (SELECT parsed_id, length(extracted_text) AS n, unnest(string_split(extracted_text, chr(10))) AS raw, generate_subscripts(string_split(extracted_text, chr(10)), 1) AS i FROM parsed_documents)) WHERE start_char < n"""
_NOTES = "FROM orders JOIN customer ON o_custkey = c_custkey"
_FIRST_UPLOADS = "SELECT upload_id, file_no, arg_min(filename, received_at) AS filename, arg_min(file_size, received_at) AS file_size, arg_min(upload_timestamp, received_at) AS upload_timestamp FROM uploads GROUP BY ALL"
_LISTS = "entities, facts, definitions, metrics, dates, refs"
_KNOWN = f"SELECT DISTINCT k.chunk_id, {_LISTS}, confidence, parsed_id, chunk_index FROM knowledge_objects k JOIN (SELECT DISTINCT chunk_id, parsed_id, chunk_index FROM document_chunks) USING (chunk_id)"
_CHUNKS = "SELECT DISTINCT chunk_id, parsed_id, document_filename, chunk_index, text, start_char, end_char, word_count, character_count FROM document_chunks"
_NAME = r"list_extract(string_split(rtrim(replace(filename, '\', '/'), '/'), '/'), -1)"
_WORDS = f"len(regexp_extract_all(text, '[^{_W}]+'))"
_UUID = "s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', s[17:17]) - 1) % 4 + 1, 1) || s[18:20] || '-' || s[21:32]"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
#: Lines with their kinds: the rules of headings, lists and paragraphs without look-around.
_LINE_KINDS = rf"""SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(line, '^[{_W}]{{0,3}}#{{1,6}}[{_W}]+[^{_W}]') THEN 'heading' WHEN regexp_matches(line, '^[{_W}]*(?:[-*+•][{_W}]+|\p{{Nd}}+[.)][{_W}]+)') THEN 'list'
  WHEN length(t) <= 120 AND len(regexp_extract_all(t, '[^{_W}]+')) <= 12 AND right(t, 1) NOT IN ('.', '?', '!', ';', ':') AND next = ''
    AND (regexp_matches(line, '^[{_W}]*\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]?[{_W}]+[^{_W}]') OR regexp_matches(t, '^(?:[^{_CASED}]|[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:[^{_CASED}]|$))*$') AND regexp_matches(t, '\p{{L}}')) THEN 'heading' ELSE 'paragraph' END AS kind
  FROM (SELECT *, trim(line, {_CHARS}) AS t, lead(trim(line, {_CHARS})) OVER (PARTITION BY parsed_id ORDER BY line_no) AS next
    FROM (SELECT *, CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS line FROM ({_LINES})))"""
_GROUPS = f"""a AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY parsed_id ORDER BY line_no) THEN 1 ELSE 0 END AS new FROM ({_LINE_KINDS})),
  b AS (SELECT *, sum(new) OVER (PARTITION BY parsed_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM a),
  c AS (SELECT parsed_id, island, kind, min(start_char) AS s, max(least(start_char + length(raw) + 1, n)) AS e, CASE WHEN kind = 'list' THEN list(start_char ORDER BY start_char) ELSE [] END AS items FROM b WHERE kind <> 'blank' GROUP BY parsed_id, island, kind),
  d AS (SELECT *, coalesce(kind = 'heading' AND lead(kind) OVER w IN ('paragraph', 'list'), false) AS joins, lead(e) OVER w AS e1, lead(items) OVER w AS i1 FROM c WINDOW w AS (PARTITION BY parsed_id ORDER BY island)),
  g AS (SELECT parsed_id, CAST(row_number() OVER (PARTITION BY parsed_id ORDER BY island) - 1 AS INT) AS ord, CAST(s AS INT) AS start_char, CAST(CASE WHEN joins THEN e1 ELSE e END AS INT) AS end_char,
    CASE WHEN joins THEN 'heading_with_content' ELSE kind END AS kind, CASE WHEN joins THEN i1 ELSE items END AS items, CAST(len(CASE WHEN joins THEN i1 ELSE items END) AS INT) AS n_items
    FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY parsed_id ORDER BY island), false) AS taken FROM d) WHERE NOT taken)"""
#: Chunks of texts without a place to cut: equal steps; a rest that adds too little goes to the chunk before it.
_UNBROKEN = """SELECT parsed_id, n AS n_all, CAST(i AS INT) AS chunk_index, CAST(i * (m - o) AS INT) AS start_char, CAST(CASE WHEN i = k - 1 THEN n ELSE i * (m - o) + m END AS INT) AS end_char
  FROM (SELECT *, unnest(range(k)) AS i FROM (SELECT *, CASE WHEN c > 1 AND n - ((c - 2) * (m - o) + m) < least_ THEN c - 1 ELSE c END AS k FROM (SELECT *, CASE WHEN n <= m THEN 1 ELSE 1 + CAST(ceil((n - m) / (m - o)) AS INT) END AS c
    FROM (SELECT parsed_id, length(extracted_text) AS n, max_chars AS m, overlap_chars AS o, coalesce(min_chunk_chars, greatest(1, least(max_chars // 4, max_chars - overlap_chars))) AS least_
      FROM parsed_documents JOIN chunking_configs USING (config_id) WHERE length(extracted_text) > 0))))"""
_BLOCKS = " || ".join(
    f"rtrim(chr(10) || chr(10) || '## {title}' || coalesce(chr(10) || chr(10) || max(t) FILTER (kind = '{kind}'), ''), chr(10))"
    for title, kind in (("Key Findings", "facts"), ("Important Entities", "entities"), ("Definitions", "definitions"), ("Metrics", "metrics"), ("Timeline", "dates"), ("References", "refs"))
)


def oracle_sql() -> dict[str, str]:
    kinds = " UNION ALL ".join(
        f"SELECT parsed_id, chunk_index, chunk_id, '{c}' AS kind, unnest({c}) AS value, generate_subscripts({c}, 1) AS pos FROM k" for c in ("entities", "definitions", "metrics", "refs")
    )
    valid = " AND ".join(f"{c} IS NOT NULL" for c in COLLECTIONS)
    return {
        "t1_word_count": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_WORDS} END AS n_words, coalesce(regexp_matches(text, '[^{_W}]'), false) AS has_content FROM documents",
        "t2_character_count": "SELECT doc_id, length(text) AS n_characters FROM documents",
        "t3_lines": f"""SELECT parsed_id, CAST(line_no AS INT) AS line_no, start_char, CAST(start_char + length(raw) AS INT) AS end_char,
            CAST(least(start_char + length(raw) + 1, n) AS INT) AS next_start, sha256(CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, length(raw) - 1) ELSE raw END) AS line_hash FROM ({_LINES})""",
        "t8_sentences": f"SELECT doc_id, CAST(n - 1 AS INT) AS pos, sentence FROM ({_SENTENCES})",
        "t9_fingerprint": "SELECT parsed_id, sha256(filename || chr(31) || file_type || chr(31) || extracted_text) AS fingerprint FROM parsed_documents",
        "t10_chunk_ids": f"""WITH h AS (SELECT doc_id, sha1(unhex('{T.CHUNK_NAMESPACE.replace("-", "")}') || encode(sha256(text) || chr(31) || '0' || chr(31) || length(text))) AS s FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', s[17:17]) - 1) % 4 + 1, 1) || s[18:20] || '-' || s[21:32] AS chunk_id FROM h""",
        "t11_metadata": """SELECT DISTINCT chunk_id, metadata IS NOT NULL AND metadata.source_metadata IS NULL AS own_plain, metadata IS NOT NULL AS own_nested, false AS deep_plain,
            metadata IS NOT NULL AND metadata.source_metadata IS NULL AS deep_nested, false AS broken_plain, false AS broken_nested FROM document_chunks""",
        "t5_line_kinds": f"SELECT parsed_id, kind, count(*) AS n_lines FROM ({_LINE_KINDS}) GROUP BY ALL",
        "g1_groups": f"WITH {_GROUPS} SELECT parsed_id, ord, start_char, end_char, kind, n_items FROM g",
        "g3_boundaries": f"""WITH {_GROUPS} SELECT parsed_id, 'hard' AS side, start_char AS at_char FROM g WHERE ord > 0 UNION SELECT parsed_id, 'hard', 0 FROM parsed_documents WHERE extracted_text IS NOT NULL
            UNION SELECT parsed_id, 'hard', CAST(length(extracted_text) AS INT) FROM parsed_documents WHERE extracted_text IS NOT NULL UNION SELECT parsed_id, 'soft', CAST(unnest(items[2:]) AS INT) FROM g""",
        "c12_unbroken": f"SELECT parsed_id, chunk_index, start_char, end_char FROM ({_UNBROKEN})",
        "c16_unbroken": f"""WITH h AS (SELECT *, sha1(unhex('{T.CHUNK_NAMESPACE.replace("-", "")}') || encode(sha256(parsed_id || chr(31) || 'txt' || chr(31) || repeat('x', n_all)) || chr(31) || start_char || chr(31) || end_char)) AS s FROM ({_UNBROKEN}))
            SELECT {_UUID} AS chunk_id, parsed_id, chunk_index, start_char, end_char, CAST(1 AS BIGINT) AS word_count, CAST(end_char - start_char AS BIGINT) AS character_count, CAST(end_char - start_char AS INT) AS n, CAST(NULL AS VARCHAR) AS error_code FROM h""",
        # A heading of 15 characters and items of 30 in chunks of 100: two items with the heading, then three each; a rest is long enough.
        "c12_lists": """WITH o AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey, k, unnest(range(CASE WHEN k <= 2 THEN 1 ELSE 1 + CAST(ceil((k - 2) / 3.0) AS INT) END)) AS i FROM o)
            SELECT l_orderkey, CAST(i AS INT) AS chunk_index, CAST(CASE i WHEN 0 THEN 0 ELSE 75 + 90 * (i - 1) END AS INT) AS start_char, CAST(least(15 + 30 * k, 75 + 90 * i) AS INT) AS end_char FROM c""",
        "c14_document_errors": f"""SELECT parsed_id, CASE WHEN NOT coalesce(regexp_matches(filename, '[^{_W}]'), false) OR NOT coalesce(file_type IN ('pdf', 'docx', 'md', 'txt'), false) OR page_count < 0
            OR NOT coalesce(word_count >= 0 AND character_count >= 0, false) THEN 'invalid_document' WHEN NOT coalesce(regexp_matches(extracted_text, '[^{_W}]'), false) THEN 'empty_text'
            WHEN character_count <> length(extracted_text) OR word_count <> len(regexp_extract_all(extracted_text, '[^{_W}]+')) THEN 'invalid_document' END AS error_code FROM parsed_documents""",
        "c5_nearest": f"""WITH c AS ({_CHUNKS}), d AS (SELECT parsed_id, CAST(max(end_char) // 2 AS INT) AS m, max(end_char) AS n FROM c GROUP BY parsed_id)
            SELECT parsed_id, max(start_char) FILTER (start_char <= m) AS last_start, min(start_char) FILTER (start_char >= m AND start_char <= n) AS first_start,
            arg_min(start_char, abs(start_char - m) * 100000 + start_char) FILTER (start_char >= 0 AND start_char < n) AS nearest_start FROM c JOIN d USING (parsed_id) GROUP BY parsed_id""",
        "c15_invariants": """WITH c AS (SELECT DISTINCT parsed_id, chunk_index, start_char AS s, end_char AS e FROM document_chunks), w AS (SELECT c.*, length(extracted_text) AS n, lag(s) OVER o AS s0, lag(e) OVER o AS e0, lead(s) OVER o IS NULL AS last
            FROM c JOIN parsed_documents USING (parsed_id) WINDOW o AS (PARTITION BY parsed_id ORDER BY chunk_index))
            SELECT parsed_id, 'cover' AS rule FROM w WHERE s0 IS NULL AND s <> 0 OR last AND e <> n UNION SELECT parsed_id, 'range' FROM w WHERE s < 0 OR e <= s OR e > n UNION
            SELECT parsed_id, 'size' FROM w WHERE e - s > CASE WHEN last THEN 1000 ELSE 800 END UNION SELECT parsed_id, 'progress' FROM w WHERE s <= s0 UNION SELECT parsed_id, 'gap' FROM w WHERE s > e0 UNION
            SELECT parsed_id, 'end' FROM w WHERE e <= e0 UNION SELECT parsed_id, 'contribution' FROM w WHERE e > e0 AND e - e0 < 200""",
        "r7_markdown": f"""WITH k AS ({_KNOWN}), a AS ({kinds}), v AS (SELECT parsed_id, kind, value, row_number() OVER (PARTITION BY parsed_id, kind, value ORDER BY chunk_index, chunk_id, pos) AS r, chunk_index, chunk_id, pos FROM a),
            l AS (SELECT parsed_id, kind, string_agg('- ' || value, chr(10) ORDER BY chunk_index, chunk_id, pos) AS t FROM v WHERE r = 1 GROUP BY ALL),
            f AS (SELECT parsed_id, chunk_index, chunk_id, unnest(facts) AS v, generate_subscripts(facts, 1) AS pos FROM k), m AS (SELECT *, row_number() OVER (PARTITION BY parsed_id ORDER BY chunk_index, chunk_id, pos) AS i FROM f),
            t AS (SELECT parsed_id, chunk_index, chunk_id, unnest(dates) AS v, generate_subscripts(dates, 1) AS pos FROM k),
            x AS (SELECT parsed_id, 'facts' AS kind, string_agg('- **Finding ' || i || '**: ' || v, chr(10) ORDER BY i) AS t FROM m GROUP BY ALL UNION ALL SELECT * FROM l UNION ALL
              SELECT parsed_id, 'dates', string_agg('- **' || v || '**: Extracted date: ' || v || '.', chr(10) ORDER BY chunk_index, chunk_id, pos) FROM t GROUP BY ALL),
            p AS (SELECT parsed_id, count(*) AS n FROM k GROUP BY ALL)
            SELECT p.parsed_id, '# Research Report' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10) || 'Research report generated from ' || any_value(n) || ' extracted knowledge objects.' || {_BLOCKS} || chr(10) AS markdown,
            CAST(NULL AS VARCHAR) AS error_code FROM p LEFT JOIN x USING (parsed_id) GROUP BY p.parsed_id""",
        "k4_entities": f"""SELECT o_orderkey AS key, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Order Desk' ELSE 'Invoice Ledger' END AS value
            {_NOTES} CROSS JOIN (VALUES (0), (1)) v(p)""",
        "k7_dates": f"""SELECT o_orderkey AS key, CAST(length(c_mktsegment) + 24 + length(format('{{:,.2f}}', o_totalprice)) AS INT) AS start_char, strftime(o_orderdate, '%Y-%m-%d') AS value {_NOTES}""",
        "k8_metrics": f"""SELECT o_orderkey AS key, '$' || format('{{:,.2f}}', o_totalprice) AS value {_NOTES}""",
        "k9_references": f"""SELECT o_orderkey AS key, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN 'http://shop.example/o/' || o_orderkey ELSE '[order](http://shop.example/p/' || o_custkey || ')' END AS value
            {_NOTES} CROSS JOIN (VALUES (0), (1)) v(p)""",
        "k5_facts": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS pos, sentence AS fact FROM ({_SENTENCES}) WHERE len(regexp_extract_all(sentence, '[^{_W}]+')) >= 3",
        "k6_definitions": rf"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS pos, sentence AS definition FROM ({_SENTENCES})
            WHERE regexp_matches(sentence, '(?i)^[{_W}]*.+?[{_W}]+(?:is|refers[{_W}]+to|means)[{_W}]+.+?\.[{_W}]*$')""",
        "k10_merged": f"""WITH c AS ({_CHUNKS}), m AS (SELECT parsed_id, start_char, end_char, max(end_char) OVER (PARTITION BY parsed_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
            i AS (SELECT *, sum(CASE WHEN start_char <= b THEN 0 ELSE 1 END) OVER (PARTITION BY parsed_id ORDER BY start_char, end_char ROWS UNBOUNDED PRECEDING) AS g FROM m)
            SELECT parsed_id, min(start_char) AS start_char, max(end_char) AS end_char FROM i GROUP BY parsed_id, g""",
        "e1_chunk_errors": f"""WITH c AS ({_CHUNKS}) SELECT chunk_id, CASE WHEN NOT coalesce(regexp_matches(text, '[^{_W}]'), false) THEN 'text has no content' WHEN NOT (start_char >= 0 AND end_char > start_char) THEN 'offsets are invalid'
            WHEN end_char - start_char <> length(text) THEN 'offsets are not those of the text' WHEN character_count <> length(text) THEN 'character_count is not that of the text'
            WHEN word_count <> {_WORDS} THEN 'word_count is not that of the text' END AS message FROM c""",
        "e3_knowledge_errors": f"""SELECT chunk_id, CASE {" ".join(f"WHEN {c} IS NULL OR len(list_filter({c}, lambda x: x IS NULL)) > 0 THEN '{c} is no list of strings'" for c in COLLECTIONS)}
            WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence is not from 0 to 1' END AS message FROM (SELECT DISTINCT chunk_id, {_LISTS}, confidence FROM knowledge_objects)""",
        "l5_answers": f"""WITH k AS (SELECT DISTINCT chunk_id, {_LISTS}, confidence FROM knowledge_objects WHERE {valid})
            SELECT chunk_id || '/' || v AS chunk_id, CASE v WHEN 'broken' THEN 'malformed_json' WHEN 'bracket' THEN 'malformed_json' WHEN 'blank' THEN 'unexpected_response' WHEN 'right' THEN NULL ELSE 'schema_validation' END AS error_code,
            CASE WHEN v = 'right' THEN CAST(len(entities) AS INT) END AS n_entities FROM k CROSS JOIN (VALUES ('right'), ('missing'), ('extra'), ('range'), ('broken'), ('bracket'), ('blank')) t(v)""",
        "r2_distinct": f"""WITH k AS ({_KNOWN}), a AS ({kinds}), f AS (SELECT *, row_number() OVER (PARTITION BY parsed_id, kind, value ORDER BY chunk_index, chunk_id, pos) AS r FROM a)
            SELECT parsed_id, kind, value, row_number() OVER (PARTITION BY parsed_id, kind ORDER BY chunk_index, chunk_id, pos) AS number FROM f WHERE r = 1""",
        "r3_findings": f"""WITH k AS ({_KNOWN}), a AS (SELECT parsed_id, chunk_index, chunk_id, unnest(facts) AS description, generate_subscripts(facts, 1) AS pos FROM k),
            n AS (SELECT *, row_number() OVER (ORDER BY parsed_id, chunk_index, chunk_id, pos) AS number FROM a) SELECT number, 'Finding ' || number AS title, description, chunk_id FROM n""",
        "r4_timeline": f"""WITH k AS ({_KNOWN}), a AS (SELECT parsed_id, chunk_index, chunk_id, unnest(dates) AS date, generate_subscripts(dates, 1) AS pos FROM k)
            SELECT parsed_id, row_number() OVER (PARTITION BY parsed_id ORDER BY chunk_index, chunk_id, pos) AS number, date, 'Extracted date: ' || coalesce(date, 'null') || '.' AS description, chunk_id FROM a""",
        "r5_summary": f"""WITH k AS ({_KNOWN}) SELECT parsed_id, 'Research Report' AS title, 'Research report generated from ' || count(*) || ' extracted knowledge objects.' AS executive_summary,
            CAST(sum(coalesce(len(facts), 0)) AS INT) AS n_findings, CAST(count(DISTINCT chunk_id) * 0 + len(list_distinct(flatten(list(coalesce(entities, []))))) AS INT) AS n_entities,
            CAST(len(list_distinct(flatten(list(coalesce(refs, []))))) AS INT) AS n_refs FROM k GROUP BY parsed_id""",
        "s2_health": "SELECT 'healthy' AS status, 'marginalia' AS service, '0.1.0' AS version",
        "s5_upload_checks": f"""WITH u AS ({_FIRST_UPLOADS}), e AS (SELECT *, CASE WHEN filename IS NULL OR filename = '' OR {_NAME} IN ('', '.', '..') THEN 'upload_validation'
            WHEN NOT regexp_matches(lower({_NAME}), '[^.].*\\.(pdf|docx|md|txt)$|^[^.]\\.(pdf|docx|md|txt)$') THEN 'unsupported_type' WHEN file_size > 40000 THEN 'upload_too_large' END AS error_code FROM u)
            SELECT upload_id, file_no, error_code, CASE error_code WHEN 'upload_validation' THEN 400 WHEN 'unsupported_type' THEN 415 WHEN 'upload_too_large' THEN 413 END AS http_status,
            max(error_code IS NOT NULL) OVER (PARTITION BY upload_id) = false AS accepted FROM e""".replace("\\\\", "\\"),
        "s7_stored_names": f"""WITH u AS ({_FIRST_UPLOADS}), n AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY file_no) AS i FROM u)
            SELECT upload_id, file_no, lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INT), '0') || '_' || {_NAME} AS stored_name, lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) AS suffix FROM n""".replace("\\\\", "\\"),
        "s9_batches": f"WITH u AS ({_FIRST_UPLOADS}) SELECT upload_id, epoch_us(max(upload_timestamp)) AS at_us, 'uploaded' AS status, CAST(count(*) AS INT) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM u GROUP BY upload_id",
    }
