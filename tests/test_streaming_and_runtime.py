from pyspark.sql import functions as F

from marginalia import runtime
from marginalia.operators.planner import ChunkingConfig
from marginalia.streaming import ingest


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    text = "# Head\n\nAda Lovelace met IBM on 2024-01-15. It was a good day."
    rows = [("a.txt", "txt", text, None, len(text.split()), len(text), None)]
    from marginalia.schemas import PARSED_DOCUMENT

    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(rows, PARSED_DOCUMENT).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.run(ingest.documents(spark, source), out, f"file://{tmp_path}/check", ChunkingConfig(40, 5)).awaitTermination(120)
    chunks = spark.read.parquet(f"{out}/chunks")
    knowledge = spark.read.parquet(f"{out}/knowledge")
    assert chunks.count() == knowledge.count() > 1
    assert "IBM" in {e for r in knowledge.collect() for e in r.entities or []}


def test_arrivals_are_windowed(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    query = ingest.arrivals(stream, "t", "k").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("arrivals").collect()) == [("a", 2), ("b", 1)]


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("x", F.array(F.lit("a")))
    kept = runtime.stage(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 10
    assert runtime.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
