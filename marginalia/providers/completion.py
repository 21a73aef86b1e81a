"""Knowledge from a chat-completion service.

The transport is a function given by the caller; nothing here opens a connection. Answers are checked in
columns, so that failures are rows with an error code. Neither texts nor keys are logged.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.functions import text as T
from marginalia.schemas import ANSWER_COLLECTIONS, COLLECTIONS

log = logging.getLogger(__name__)

PROMPT = (
    "You extract knowledge from a passage of a document. Answer with a single JSON object that has exactly the keys "
    + ", ".join(ANSWER_COLLECTIONS)
    + " (each a list of strings, empty if there is nothing to list) and confidence (a number between 0 and 1). Write nothing besides the object."
)
#: (request) to the completion as a dict, e.g. {"choices": [{"message": {"content": "..."}}]}.
Transport = Callable[[dict[str, Any]], Any]
# What a transport's exceptions mean, by class name; a timeout is looked for before a lost connection.
KINDS = {"APITimeoutError": "timeout", "TimeoutError": "timeout", "AuthenticationError": "authentication", "RateLimitError": "rate_limit", "APIConnectionError": "network", "ConnectionError": "network"}


def configuration(key: str | None, model: str | None) -> tuple[str, str]:
    """Key and model without blanks around them; an error for what is missing, before anything is sent."""
    if not isinstance(key, str) or not key.strip():
        raise errors.PROVIDER["missing_key"]("no key is configured")
    if not isinstance(model, str) or not model.strip():
        raise errors.PROVIDER["missing_model"]("no model is configured")
    return key.strip(), model.strip()


def request(model: str, text: str) -> dict[str, Any]:
    """One request for one chunk: instructions and the text as it is, no randomness, no stream, a JSON object."""
    messages = [{"role": "system", "content": PROMPT}, {"role": "user", "content": text}]
    return {"model": model, "messages": messages, "temperature": 0, "stream": False, "response_format": {"type": "json_object"}}


def failure(e: BaseException) -> str:
    """The error code of a transport's exception, by its classes from the most special on."""
    names = [c.__name__ for c in type(e).__mro__]
    return next((code for name, code in KINDS.items() if name in names), "provider")


def content(completion: Any) -> str | None:
    """The first choice's text, or None if there is no usable one."""
    try:
        text = completion["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        return None
    return text if isinstance(text, str) and text.strip() else None


def ask(chunks: DataFrame, connect: Callable[[str], Transport], key: str | None, model: str | None) -> DataFrame:
    """(chunk_id, content, code): each chunk's answer, or the code of what failed. No request is repeated.

    ``connect`` makes a transport from the key, once for each task.
    """
    key, model = configuration(key, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = connect(key)
        for batch in batches:
            rows: list[tuple[str, str | None, str | None]] = []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                began, answer, code = time.perf_counter(), None, None
                try:
                    answer = content(send(request(model, text)))
                    code = None if answer else "unexpected_response"
                except Exception as e:  # what a transport raises isn't known here
                    code = failure(e)
                log.info("knowledge request %s | chunk_id=%s | model=%s | elapsed_ms=%.2f", code or "succeeded", chunk_id, model, (time.perf_counter() - began) * 1000)
                rows.append((chunk_id, answer, code))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (a, b, c)], names=["chunk_id", "content", "code"])

    return chunks.select("chunk_id", "text").mapInArrow(run, "chunk_id string, content string, code string")


def _code(value: Column, text: Column) -> Column:
    keys = F.array_sort(F.json_object_keys(text))
    wanted = F.array(*(F.lit(k) for k in sorted([*ANSWER_COLLECTIONS, "confidence"])))
    lists = [F.schema_of_variant(F.try_variant_get(value, f"$.{c}", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(~F.exists(F.try_variant_get(value, f"$.{c}", "array<string>"), lambda x: x.isNull()), F.lit(False)) for c in ANSWER_COLLECTIONS]
    number = F.schema_of_variant(F.try_variant_get(value, "$.confidence", "variant")).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$") & F.try_variant_get(value, "$.confidence", "double").between(0, 1)
    fits = keys == wanted
    for check in (*lists, number):
        fits = fits & check
    return F.when(value.isNull(), "malformed_json").when(~F.coalesce(fits, F.lit(False)), "schema_validation")


def answer_code(text: Column) -> Column:
    """Null for an answer of the right shape, else ``malformed_json`` or ``schema_validation``.

    All keys must be there and no others; lists must hold strings alone; confidence is a number from 0 to 1.
    """
    return T.let(T.json_value(text), lambda value: _code(value, text))


def answers(df: DataFrame) -> DataFrame:
    """Knowledge objects with ``error`` from (chunk_id, content, code); each content is parsed once."""
    text = F.col("content")
    early = F.coalesce("code", F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unexpected_response"))

    def read(value: Column) -> Column:
        lists = [F.try_variant_get(value, f"$.{a}", "array<string>").alias(c) for a, c in zip(ANSWER_COLLECTIONS, COLLECTIONS)]
        return F.struct(_code(value, text).alias("code"), *lists, F.try_variant_get(value, "$.confidence", "double").alias("confidence"))

    rows = df.select("chunk_id", early.alias("early"), T.let(T.json_value(F.when(early.isNull(), text)), read).alias("read"))
    code = F.coalesce("early", "read.code")
    error = F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit("the provider gave no usable answer").alias("message")))
    good = [F.when(code.isNull(), F.col(f"read.{c}")).alias(c) for c in (*COLLECTIONS, "confidence")]
    return rows.select("chunk_id", *good, error.alias("error"))


def provider(connect: Callable[[str], Transport], key: str | None, model: str | None) -> Callable[[DataFrame], DataFrame]:
    """A provider for ``operators.extract.process``."""
    configuration(key, model)
    return lambda chunks: answers(ask(chunks, connect, key, model))
