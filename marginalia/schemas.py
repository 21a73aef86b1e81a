"""Schemas of the entities."""

from __future__ import annotations

UPLOADED_FILE = "filename string, content_type string, file_size bigint, upload_timestamp timestamp, status string"
UPLOAD_BATCH = f"upload_id string, upload_timestamp timestamp, status string, files array<struct<{UPLOADED_FILE.replace(' ', ':').replace(',:', ',')}>>"
PARSED_DOCUMENT = "filename string, file_type string, extracted_text string, page_count int, word_count bigint, character_count bigint, metadata map<string,string>"
DOCUMENT_CHUNK = "chunk_id string, document_filename string, chunk_index int, text string, start_char int, end_char int, word_count bigint, character_count bigint, metadata struct<source_file_type:string,source_metadata:map<string,string>>"
COLLECTIONS = ("entities", "facts", "definitions", "metrics", "dates", "refs")
#: The names of the collections in a provider's JSON answer.
ANSWER_COLLECTIONS = ("entities", "facts", "definitions", "metrics", "dates", "references")
KNOWLEDGE_OBJECT = "chunk_id string, " + ", ".join(f"{c} array<string>" for c in COLLECTIONS) + ", confidence double"
FINDING = "struct<title:string,description:string,supporting_chunk_ids:array<string>>"
TIMELINE_EVENT = "struct<date:string,description:string,supporting_chunk_ids:array<string>>"
SECTION = "struct<heading:string,content:string>"
REPORT = (
    f"title string, executive_summary string, findings array<{FINDING}>, important_entities array<string>, important_definitions array<string>, "
    f"important_metrics array<string>, timeline array<{TIMELINE_EVENT}>, refs array<string>, sections array<{SECTION}>"
)
FILE_TYPES = ("pdf", "docx", "md", "txt")
