import random

import pytest
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.functions import text as T
from marginalia.operators import chunks, scan, structure
from marginalia.operators.planner import ChunkingConfig, Planner, broken_rules

PARTS = ["word ", "# Head\n", "\n", "\n\n", "- item one\n", "Title Line\n\n", "end. ", "1. a\n", "1.2 Foo\n\n", "é\r\n", "  \n", "Ends here.\n\n", "x" * 40]


def random_texts(n, seed=3, longest=40):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest)))) for i in range(n)]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "id int, extracted_text string")
    text = F.col("extracted_text")
    return df.select(
        F.concat(F.lit("f"), "id").alias("filename"), F.lit("txt").alias("file_type"), "extracted_text", F.lit(None).cast("int").alias("page_count"), T.word_count(text).alias("word_count"),
        T.character_count(text).alias("character_count"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("other").alias("error_note"),
    )


def plan(text, config):
    return Planner(text, *scan.boundaries(text), config).spans()


def test_golden_plans():
    assert plan("x" * 250, ChunkingConfig(100, 20)) == [(0, 100), (80, 180), (160, 250)]
    assert plan("x" * 200, ChunkingConfig(100, 20, 30)) == [(0, 100), (80, 200)]
    assert ChunkingConfig(100, 20).least == 25 and ChunkingConfig(100, 20, 30).least == 30
    head = "# Methods\n\nThe body of the methods section goes here and is longer.\n\nNext part follows.\n"
    assert any(head[a:b].startswith("# Methods") and "body" in head[a:b] for a, b in plan(head, ChunkingConfig(80, 0)))
    bullets = "".join(f"- item number {i} of the list\n" for i in range(6))
    spans = plan(bullets, ChunkingConfig(80, 0))
    assert all(any(line in bullets[a:b] for a, b in spans) for line in bullets.splitlines())


@pytest.mark.parametrize("sizes", [(0, 0), (10, 10), (10, -1), (10, 5, 0), (10, 5, 6), (True, 0)])
def test_bad_configurations(sizes):
    with pytest.raises(errors.CHUNK["invalid_config"]):
        ChunkingConfig(*sizes)


def test_plans_keep_the_rules_and_rebuild_the_text():
    rng = random.Random(5)
    for _, text in random_texts(600, seed=8, longest=60):
        size = rng.randint(5, 200)
        config = ChunkingConfig(size, rng.randint(0, size - 1))
        spans = plan(text, config)
        assert not text or broken_rules(spans, len(text), config) == []
        rebuilt, at = "", 0
        for a, b in spans:
            rebuilt, at = rebuilt + text[max(a, at) : b], b
        assert rebuilt == text


def test_windows_and_scan_find_the_same_groups(spark):
    rows = random_texts(400)
    df = spark.createDataFrame(rows, "id int, text string")
    found = {}
    for r in structure.groups(df, "id", "text").collect():
        found.setdefault(r.id, []).append((r.ord, r.start, r.end, r.kind, list(r.item_starts)))
    for i, text in rows:
        assert [(k, g.start, g.end, g.kind, g.items) for k, g in enumerate(scan.groups(text))] == sorted(found.get(i, []))
    lengths = df.select("id", F.length("text").alias("n"))
    bounds = {r.id: (list(r.hard), list(r.soft)) for r in structure.boundaries(structure.groups(df, "id", "text"), lengths, "id").collect()}
    assert all(bounds[i] == tuple(scan.boundaries(text)) for i, text in rows)


def test_chunks_and_errors(spark):
    rows = [(0, "# A\n\nSome text here. More text there."), (1, "  \n"), (2, "x" * 300), (3, "x" * 300)]
    config = ChunkingConfig(100, 20)
    found = chunks.chunk(documents(spark, rows), config).collect()
    bad = [r for r in found if r.error]
    assert [(r.document_filename, r.error.code, r.text) for r in bad] == [("f1", "empty_text", None)]
    for r in found:
        if not r.error:
            text = rows[int(r.document_filename[1:])][1]
            assert r.text == text[r.start_char : r.end_char] and r.character_count == len(r.text) and r.word_count == len(r.text.split())
    assert len({r.chunk_id for r in found if not r.error}) == len(found) - 1  # the same text under two names has other ids
    with pytest.raises(Exception, match="empty_text"):
        chunks.chunk(documents(spark, rows), config, strict=True).collect()
    wrong = documents(spark, rows[:1]).withColumn("word_count", F.lit(99).cast("long"))
    assert chunks.chunk(wrong, config).collect()[0].error.code == "invalid_document"
    assert chunks.chunk(documents(spark, rows).limit(0), config).count() == 0


def test_configuration_of_each_row(spark):
    df = spark.createDataFrame([(1, "x" * 250, 100, 20, None), (2, "x" * 250, 10, 20, None), (3, None, 100, 20, None), (4, "", 100, 20, None)], "id int, text string, max_chars int, overlap_chars int, min_chunk_chars int")
    assert sorted(map(tuple, chunks.plan(df, "id", "text").collect())) == [(1, 0, 0, 100), (1, 1, 80, 180), (1, 2, 160, 250)]


def test_broken_spans_are_reported(spark):
    config = ChunkingConfig(10, 2, 3)
    spans = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 12, 20), (2, 0, 1, 10), (3, 0, 0, 30)], "id int, chunk_index int, start_char int, end_char int")
    lengths = spark.createDataFrame([(1, 20), (2, 10), (3, 30)], "id int, n int")
    found = sorted(map(tuple, chunks.invariants(spans, lengths, "id", config).collect()))
    assert found == [(1, "gap"), (2, "cover"), (3, "size")]


def test_boundary_lookups(spark):
    df = spark.createDataFrame([([0, 5, 9, 14], 7)], "p array<int>, t int")
    lit = F.lit
    r = df.select(
        structure.last_between(F.col("p"), lit(0), F.col("t")).alias("last"), structure.first_between(F.col("p"), F.col("t"), lit(20)).alias("first"), structure.nearest(F.col("p"), F.col("t"), lit(0), lit(14)).alias("near"),
        structure.last_between(F.col("p"), lit(5), F.col("t")).alias("no_last"), structure.first_between(F.col("p"), lit(15), lit(20)).alias("no_first"), structure.nearest(F.col("p"), F.col("t"), lit(10), lit(14)).alias("no_near"),
    ).first()
    assert tuple(r) == (5, 9, 5, None, None, None)
