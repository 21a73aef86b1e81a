import pytest
from pyspark.sql import functions as F

from marginalia.operators import extract
from marginalia.plans import report

TEXT = "Ada Lovelace met IBM on 2024-01-15. It cost $1,200.50 or 12% of 5 kg. A widget is a small tool. See https://x.org/a. and [doc 2020](http://y.org/2021) in March 2020."
UUIDS = ["00000000-0000-4000-8000-00000000000%d" % i for i in range(4)]


def test_golden_extraction(spark):
    r = extract.knowledge(spark.createDataFrame([("a", TEXT)], "chunk_id string, text string"), "chunk_id", "text").first()
    assert r.entities == ["Ada Lovelace", "IBM"]
    assert r.facts == ["Ada Lovelace met IBM on 2024-01-15.", "It cost $1,200.50 or 12% of 5 kg.", "A widget is a small tool.", "and [doc 2020](http://y.org/2021) in March 2020."]
    assert r.definitions == ["A widget is a small tool."] and r.metrics == ["$1,200.50", "12%", "5 kg"]
    assert r.dates == ["2024-01-15", "March 2020"] and r.refs == ["https://x.org/a", "[doc 2020](http://y.org/2021)"] and r.confidence == 1.0


@pytest.mark.parametrize(
    ("text", "metrics", "dates"),
    [("12kg", [], []), ("-5", ["5"], []), ("v2.0", [], []), ("1,00", ["1", "00"], []), ("1.2.3", ["1.2"], []), ("5%x", ["5"], []), ("$1988.82", [], ["1988"]), ("9999-99-99", [], ["9999-99-99"]), ("no match here", [], [])],
)
def test_rule_edges(spark, text, metrics, dates):
    r = extract.knowledge(spark.createDataFrame([("a", text)], "chunk_id string, text string"), "chunk_id", "text").first()
    assert (r.metrics, r.dates) == (metrics, dates)


def test_null_and_empty_texts(spark):
    rows = extract.knowledge(spark.createDataFrame([("a", None), ("b", "")], "chunk_id string, text string"), "chunk_id", "text").orderBy("chunk_id").collect()
    assert rows[0].entities is None and rows[1].entities == [] and rows[1].facts == []


def chunk_rows(spark, texts, **other):
    rows = [(UUIDS[i], "f", i, t, 0, len(t), len(t.split()), len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id string, document_filename string, chunk_index int, text string, start_char int, end_char int, word_count bigint, character_count bigint")
    return df.withColumns({k: F.lit(v) for k, v in other.items()})


def test_process_keeps_repeats_and_reports_errors(spark):
    good = chunk_rows(spark, ["A cat is an animal.", "A cat is an animal."])
    assert extract.process(good.unionByName(good)).where("error IS NULL").count() == 4
    assert extract.process(chunk_rows(spark, [" \n"])).first().error.message == "text has no content"
    assert "word_count" in extract.process(chunk_rows(spark, ["a b"], word_count=9)).first().error.message
    with pytest.raises(Exception, match="extraction"):
        extract.process(chunk_rows(spark, [" "]), strict=True).collect()
    worse = lambda c: extract.knowledge(c, "chunk_id", "text").withColumn("confidence", F.lit(float("nan")))
    assert extract.process(good, worse).first().error.code == "invalid_knowledge"


def objects(spark):
    rows = [
        (1, 0, UUIDS[0], ["A", "B", "A"], ["F one."], ["D"], ["1"], ["2020"], ["r"]),
        (1, 1, UUIDS[1], ["B", "C"], ["F one.", "F two."], ["D"], ["2"], ["2020", "1999"], []),
    ]
    return spark.createDataFrame(rows, "doc int, chunk_index int, chunk_id string, entities array<string>, facts array<string>, definitions array<string>, metrics array<string>, dates array<string>, refs array<string>")


def test_synthesis_and_markdown(spark):
    r = report.render(report.synthesize(objects(spark), ["chunk_index"], ["doc"])).first()
    assert r.important_entities == ["A", "B", "C"] and [f.title for f in r.findings] == ["Finding 1", "Finding 2", "Finding 3"]
    assert [(e.date, e.supporting_chunk_ids) for e in r.timeline] == [("2020", [UUIDS[0]]), ("2020", [UUIDS[1]]), ("1999", [UUIDS[1]])]
    assert r.markdown == (
        "# Research Report\n\n## Executive Summary\n\nResearch report generated from 2 extracted knowledge objects.\n\n## Key Findings\n\n- **Finding 1**: F one.\n- **Finding 2**: F one.\n"
        "- **Finding 3**: F two.\n\n## Important Entities\n\n- A\n- B\n- C\n\n## Definitions\n\n- D\n\n## Metrics\n\n- 1\n- 2\n\n## Timeline\n\n- **2020**: Extracted date: 2020.\n"
        "- **2020**: Extracted date: 2020.\n- **1999**: Extracted date: 1999.\n\n## References\n\n- r\n"
    )


def test_long_forms_agree_with_the_report(spark):
    found = report.findings(objects(spark), ["doc", "chunk_index"], [])
    assert [tuple(x) for x in found.orderBy("number").select("number", "description").collect()] == [(1, "F one."), (2, "F one."), (3, "F two.")]
    values = report.distinct_values(objects(spark), ["chunk_index"], ["doc"]).where("kind = 'entities'").orderBy("number")
    assert [r.value for r in values.collect()] == ["A", "B", "C"]
    assert report.timeline(objects(spark), ["chunk_index"], ["doc"]).count() == 3


def test_empty_report_has_headings_only(spark):
    empty = objects(spark).select("doc", "chunk_index", "chunk_id", *(F.lit(None).cast("array<string>").alias(c) for c in ("entities", "facts", "definitions", "metrics", "dates", "refs"))).limit(1)
    r = report.render(report.synthesize(empty, ["chunk_index"], ["doc"])).first()
    assert r.markdown.endswith("## Key Findings\n\n## Important Entities\n\n## Definitions\n\n## Metrics\n\n## Timeline\n\n## References\n")


def test_invalid_reports(spark):
    made = report.synthesize(objects(spark), ["chunk_index"], ["doc"])
    twice = made.withColumn("refs", F.array(F.lit("r"), F.lit("r")))
    r = report.render(twice).first()
    assert r.error.code == "invalid_report" and r.markdown is None
    with pytest.raises(Exception, match="invalid_report"):
        report.render(twice, strict=True).collect()
    assert report.render(made.withColumn("title", F.lit(None).cast("string"))).first().error is not None
