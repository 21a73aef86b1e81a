"""Continuous ingest: new parsed documents to chunks and knowledge, by Structured Streaming.

Chunking and extraction are narrow, so they run on a stream as they do on a table and need no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marginalia.operators import chunks, extract
from marginalia.operators.planner import ChunkingConfig
from marginalia.schemas import PARSED_DOCUMENT


def documents(spark: SparkSession, path: str, schema: str = PARSED_DOCUMENT, most_files: int = 1000) -> DataFrame:
    """A stream of the parquet files that appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str, config: ChunkingConfig, extra: Callable[[DataFrame], None] | None = None, **trigger: object) -> StreamingQuery:
    """Write chunks and knowledge of each micro-batch below ``out``; a batch that is repeated replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        made = chunks.chunk(df, config)
        made.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        written = df.sparkSession.read.schema(made.schema).parquet(f"{out}/chunks/batch={number}")
        extract.process(written.where("error IS NULL").drop("error")).write.mode("overwrite").parquet(f"{out}/knowledge/batch={number}")
        if extra:
            extra(written)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals(stream: DataFrame, time_col: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records by arrival window and ``by``, late ones counted until the watermark passes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), by).agg(F.count("*").alias("n"))
