"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import ledger, names, neardup, packing, plain, scans, spans, splitting, tokens
from marginalia.runtime import stage, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(kind, key, doc, text) of parsed documents and chunks."""
    documents = table(spark, d, "parsed_documents").select(F.lit("document").alias("kind"), F.col("parsed_id").alias("key"), F.col("parsed_id").alias("doc"), F.col("extracted_text").alias("text"))
    chunks = table(spark, d, "document_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.col("parsed_id").alias("doc"), "text")
    return documents.unionByName(chunks)


def _ledger(spark: SparkSession, d: str) -> ledger.Ledger:
    """The ledger after two batches, of early and of late arrivals."""
    keys = ledger.knowledge_keys(table(spark, d, "knowledge_objects"), "loaded_at").unionByName(ledger.report_keys(table(spark, d, "research_reports"), "created_at"))
    books = ledger.Ledger(spark)
    for batch in ledger.arrivals(stage(keys, "keys"), "at"):
        books.add(batch)
    return books


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.copies(_ledger(spark, d), least=3)


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's rows under the minimum of ``p1_found``, as its SQL has them; ``p1_copies`` has all."""
    books = _ledger(spark, d)
    return books.rows().join(ledger.counted(books.seen()), ["kind", "canon"], "left_semi").select("kind", "keep_key", "n_copies")


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record of each and its number of copies, over all records."""
    return _ledger(spark, d).rows().select("kind", "keep_key", "n_copies")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings(table(spark, d, "parsed_documents"), "parsed_id", "extracted_text", "file_type", "page_count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("parsed_id", "line_no", "kind").distinct()


def p3_findings(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d)


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "parsed_documents"), "parsed_id", "extracted_text", "file_type", "page_count")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "knowledge_objects").select("entities").unionAll(table(spark, d, "research_reports").select("important_entities"))
    return names.resolve(lists.select(F.explode("entities").alias("spelling")), table(spark, d, "name_aliases"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(_entities(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    documents = plain.fingerprints(table(spark, d, "parsed_documents"), "document", "parsed_id", "extracted_text")
    chunks = plain.fingerprints(table(spark, d, "document_chunks"), "chunk", "chunk_id", "text")
    return plain.same_looking(documents.unionByName(chunks))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return plain.normalise(_texts(spark, d).select("kind", "key", "text").distinct(), "text", "plain_text").drop("text")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    documents = plain.fingerprints(table(spark, d, "parsed_documents"), "document", "parsed_id", "extracted_text")
    chunks = plain.fingerprints(table(spark, d, "document_chunks"), "chunk", "chunk_id", "text")
    return plain.classes(stage(documents.unionByName(chunks), "marks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(*neardup.near_duplicates(_texts(spark, d), words=3, threshold=0.7))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.classes(*neardup.near_duplicates(_texts(spark, d), least_words=0))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.audit(table(spark, d, "document_chunks"), table(spark, d, "parsed_documents"), table(spark, d, "chunking_configs"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "chunking_configs").select("config_id", "max_chars", "overlap_chars")
    return splitting.split(table(spark, d, "parsed_documents").join(limits, "config_id", "left"), "parsed_id", "extracted_text", "max_chars", "overlap_chars")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = stage(tokens.count_tokens(table(spark, d, "documents")), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_ledger, p1_copies, p3_found, p3_findings, p3_paragraphs, p4_found, p4_entities, p5_found, p5_forms, p5_classes, p6_found, p6_classes, p7_found, p7_pieces, p8_ids, p9_containers, p10_found, p10_share]
    return {f.__name__: f for f in found}


_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSEEN = r"\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("\uff07", "")
_ALIKE = [x + y + z for x, y, z in zip((_WIDE, "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)), ("".join(plain.LOOKALIKES), "".join(plain.LOOKALIKES.values())), (plain.SPACES, " " * len(plain.SPACES)))]
_PLAIN = r"regexp_replace(translate(replace(lower({}), 'ß', 'ss'), 'ςſ', 'σs'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEYS = f"""k AS (SELECT DISTINCT 'knowledge' AS kind, chunk_id AS record_key, array_to_string(list_sort(list_transform(entities, lambda e: coalesce({_PLAIN.format('e')}, ''))), chr(31)) AS canon
    FROM knowledge_objects WHERE len(entities) >= 3 UNION ALL
    SELECT DISTINCT 'report', report_id, array_to_string(list_sort(list_transform(important_entities, lambda e: coalesce({_PLAIN.format('e')}, ''))), chr(31)) || chr(29) ||
    array_to_string(list_sort(list_transform(refs, lambda r: array_to_string(list_sort(list_filter(list_transform(string_split_regex(coalesce(r, ''), '[;|]'), lambda f: {_PLAIN.format('f')}), lambda f: f <> '')), chr(30)))), chr(31))
    FROM research_reports WHERE important_entities IS NOT NULL AND refs IS NOT NULL), g AS (SELECT kind, canon, min(record_key) AS keep_key, count(*) AS n_copies FROM k GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; problems that SQL expresses too slowly or not at all are tested against brute force instead."""
    return {
        "p1_found": f"WITH {_KEYS} SELECT k.kind, keep_key, record_key AS copy_key FROM k JOIN g USING (kind, canon) WHERE record_key <> keep_key",
        "p1_ledger": f"WITH {_KEYS} SELECT kind, keep_key, n_copies FROM g",
        "p7_found": f"""WITH c AS (SELECT DISTINCT parsed_id, chunk_index, start_char, end_char, text FROM document_chunks),
            l AS (SELECT *, lag(end_char) OVER (PARTITION BY parsed_id ORDER BY chunk_index, start_char, end_char, text) AS previous FROM c),
            j AS (SELECT l.*, extracted_text AS t, max_chars, overlap_chars FROM l JOIN parsed_documents p USING (parsed_id) LEFT JOIN chunking_configs USING (config_id))
            SELECT parsed_id, chunk_index, 'too_long' AS defect FROM j WHERE end_char - start_char > max_chars UNION
            SELECT parsed_id, chunk_index, 'offset' FROM j WHERE text IS DISTINCT FROM substr(t, start_char + 1, end_char - start_char) UNION
            SELECT parsed_id, chunk_index, 'gap' FROM j WHERE start_char > previous UNION
            SELECT parsed_id, chunk_index, 'overlap' FROM j WHERE start_char < previous - overlap_chars UNION
            SELECT parsed_id, chunk_index, 'inside_word' FROM j WHERE end_char > 0 AND end_char < length(t) AND NOT regexp_matches(substr(t, end_char, 2), '{_WHITE}')
              AND regexp_matches(substr(t, start_char + 1, end_char - start_char), '{_WHITE}')""",
        "p5_found": f"""WITH t AS (SELECT 'document' AS kind, parsed_id AS key, extracted_text AS text FROM parsed_documents UNION SELECT 'chunk', chunk_id, text FROM document_chunks),
            p AS (SELECT kind, key, text, nfc_normalize(replace(replace(replace(replace(translate(regexp_replace(text, '[{_UNSEEN}]', '', 'g'), '{_ALIKE[0]}', '{_ALIKE[1]}'), chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(65287), chr(39))) AS plain FROM t WHERE text IS NOT NULL)
            SELECT a.kind, a.key AS key_a, b.key AS key_b FROM p a JOIN p b ON a.kind = b.kind AND a.plain = b.plain AND a.key < b.key AND a.text <> b.text""",
        "p6_found": f"""WITH t AS (SELECT 'document' AS kind, parsed_id AS key, parsed_id AS doc, extracted_text AS text FROM parsed_documents UNION SELECT 'chunk', chunk_id, parsed_id, text FROM document_chunks),
            w AS (SELECT kind, key, doc, list_filter(string_split_regex(lower(text), '{_WHITE}+'), lambda x: x <> '') AS w FROM t),
            s AS (SELECT kind, key, doc, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
            u AS (SELECT kind, key, doc, len(s) AS n, unnest(s) AS shingle FROM s),
            p AS (SELECT a.kind, a.key AS key_a, b.key AS key_b, a.n AS x, b.n AS y, count(*) AS common FROM u a JOIN u b ON a.kind = b.kind AND a.shingle = b.shingle AND a.key < b.key AND a.doc <> b.doc GROUP BY ALL)
            SELECT kind, key_a, key_b FROM p WHERE 10 * common >= 7 * (x + y - common)""",
        "p10_found": """WITH w AS (SELECT doc_id, i AS a, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
            r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), m AS (SELECT doc_id, a, max(a) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 AS b FROM w SEMI JOIN r USING (h)),
            g AS (SELECT doc_id, a, sum(CASE WHEN a <= b THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM m)
            SELECT doc_id, CAST(min(a) AS INT) AS start_char, CAST(max(a) + 200 AS INT) AS end_char FROM g GROUP BY doc_id, g""",
    }
