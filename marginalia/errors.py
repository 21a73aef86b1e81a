"""Errors by family, and their form as rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class DocumentError(Exception):
    """Root of all errors here; ``code`` is what error columns and status maps hold."""

    code = "document"
    status = 500


def _family(base: type[DocumentError], **codes: int) -> dict[str, type[DocumentError]]:
    return {name: type(name, (base,), {"code": name, "status": status, "__doc__": f"Row error {name}."}) for name, status in codes.items()}


class UploadError(DocumentError):
    code = "upload"


class ParseError(DocumentError):
    code = "parse"


class ChunkError(DocumentError):
    code = "chunk"


class KnowledgeError(DocumentError):
    code = "knowledge"


class ProviderError(KnowledgeError):
    code = "provider"


class ReportError(DocumentError):
    code = "report"


UPLOAD = _family(UploadError, upload_validation=400, unsupported_type=415, upload_too_large=413, upload_storage=500)
PARSE = _family(ParseError, unsupported_file_type=415, file_access=500, empty_document=400, pdf_parsing=400, docx_parsing=400, text_decoding=400)
CHUNK = _family(ChunkError, invalid_config=400, empty_text=400, invalid_document=400, invariant=500)
KNOWLEDGE = _family(KnowledgeError, extraction=500, invalid_knowledge=500)
PROVIDER = _family(ProviderError, missing_key=500, missing_model=500, authentication=500, rate_limit=500, timeout=500, network=500, malformed_json=500, schema_validation=500, unexpected_response=500)
REPORT = _family(ReportError, invalid_report=500, synthesis=500, rendering=500)
ALL = UPLOAD | PARSE | CHUNK | KNOWLEDGE | PROVIDER | REPORT


def first_error(*checks: tuple[Column, str, str]) -> Column:
    """struct<code, message> of the first check (condition that must hold, code, message) that fails, else null.

    A condition that is null fails.
    """
    found = F.lit(None).cast("struct<code:string,message:string>")
    for condition, code, message in reversed(checks):
        found = F.when(F.coalesce(condition, F.lit(False)), found).otherwise(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    return found


def strictly(df, error_col: str = "error"):  # type: ignore[no-untyped-def]
    """``df`` that raises at its first row with an error, without the error column."""
    e = F.col(error_col)
    return df.where(F.when(e.isNotNull(), F.raise_error(F.concat_ws(": ", e["code"], e["message"])).isNull()).otherwise(F.lit(True))).drop(error_col)


def http_status(code: Column) -> Column:
    """The HTTP status that stands for an error code; 500 for an unknown one."""
    pairs = [F.lit(x) for name, kind in ALL.items() for x in (name, kind.status)]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(500))
