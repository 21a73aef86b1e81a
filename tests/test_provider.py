import json

import pytest
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.operators import extract
from marginalia.providers import completion

GOOD = {"entities": ["A"], "facts": [], "definitions": [], "metrics": [], "dates": [], "references": ["r"], "confidence": 0.5}


def answer(text):
    return {"choices": [{"message": {"content": text}}]}


def chunks(spark, texts):
    rows = [("00000000-0000-4000-8000-%012d" % i, "f", i, t, 0, len(t), len(t.split()), len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, document_filename string, chunk_index int, text string, start_char int, end_char int, word_count bigint, character_count bigint")


def connect(key):
    class RateLimitError(Exception):
        pass

    class APIConnectionError(Exception):
        pass

    class APITimeoutError(APIConnectionError):
        pass

    def send(request):
        assert key == "secret" and request["temperature"] == 0 and request["stream"] is False and request["response_format"] == {"type": "json_object"}
        text = request["messages"][1]["content"]
        raised = {"limit": RateLimitError, "timeout": APITimeoutError, "network": APIConnectionError, "other": KeyError}
        if text in raised:
            raise raised[text]("x")
        return {"none": {"choices": []}, "blank": answer(" "), "bad": answer("{"), "shape": answer("{}")}.get(text, answer(json.dumps(GOOD)))

    return send


def test_answers_and_failures_become_rows(spark):
    kinds = {"fine": None, "limit": "rate_limit", "timeout": "timeout", "network": "network", "other": "provider", "none": "unexpected_response", "blank": "unexpected_response", "bad": "malformed_json", "shape": "schema_validation"}
    found = extract.process(chunks(spark, list(kinds)), completion.provider(connect, " secret ", "model")).orderBy("chunk_id").collect()
    assert [r.error and r.error.code for r in found] == list(kinds.values())
    assert found[0].entities == ["A"] and found[0].refs == ["r"] and found[0].confidence == 0.5


def test_configuration_comes_first():
    for key, model, code in ((None, "m", "missing_key"), (" ", "m", "missing_key"), ("k", "", "missing_model")):
        with pytest.raises(errors.PROVIDER[code]):
            completion.provider(connect, key, model)


def test_shapes(spark):
    cases = {
        json.dumps(GOOD): None, json.dumps(GOOD | {"confidence": 1}): None, json.dumps(GOOD | {"more": 1}): "schema_validation", json.dumps(GOOD | {"confidence": 1.5}): "schema_validation",
        json.dumps(GOOD | {"confidence": True}): "schema_validation", json.dumps(GOOD | {"confidence": "0.5"}): "schema_validation", json.dumps(GOOD | {"facts": [1]}): "schema_validation",
        json.dumps(GOOD | {"facts": [None]}): "schema_validation", json.dumps(GOOD | {"facts": "x"}): "schema_validation", json.dumps({k: v for k, v in GOOD.items() if k != "dates"}): "schema_validation",
        json.dumps(GOOD) + "}": "malformed_json", json.dumps(GOOD) + ", {}": "malformed_json", "[]": "schema_validation", "1": "schema_validation", "x": "malformed_json",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", completion.answer_code(F.col("t")).alias("code"))
    assert [r.code for r in df.orderBy("i").collect()] == list(cases.values())


def test_no_text_in_the_log(spark, caplog):
    send = connect("secret")
    assert completion.content(send(completion.request("m", "fine"))) and not caplog.records
