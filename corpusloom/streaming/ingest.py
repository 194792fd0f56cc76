"""Structured Streaming: clean documents as they arrive, drop late repeats, keep running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T
from corpusloom.operators import clean


def documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the parquet files that appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_documents(stream: DataFrame, profiles: dict[str, str], delay: str = "7 days") -> DataFrame:
    """Accepted documents of the stream with their content hash, the first of each content within the watermark.

    State holds one hash per content and is dropped once the watermark (event time ``loaded_at`` less ``delay``)
    has passed it; repeats that come later than that are kept.
    """
    x = clean.clean_and_tag(stream, profiles).where("reject_reason is null")
    x = x.withColumn("content_sha256", T.content_hash(F.col("text")))
    return x.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["content_sha256"])


def arrivals(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(window, source, docs, chars): arrivals per event-time window and source; rows later than ``delay`` are not counted."""
    x = stream.withWatermark("loaded_at", delay)
    return x.groupBy(F.window("loaded_at", window), "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is available as parquet and stop; the checkpoint makes a restart go on where this one ended."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
