"""Event streams: ingest with a cap on dwell, windowed counts with late data, and training by batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table's files as a stream, as they arrive: the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")


def ingest(events: DataFrame, cap: float = 300_000.0) -> DataFrame:
    """``event_id, ts, user_id, event_type, dwell_ms``; a dwell counts up to the cap."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.least(F.col("value") * 1000, F.lit(cap)).alias("dwell_ms"))


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and dwell by window and kind; state is dropped once the watermark has passed a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("dwell_ms"), 3).alias("dwell_ms")).select(F.col("w.start").alias("start"), "event_type", "n", "dwell_ms")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is and ends; exactly once, by Spark's file sink and its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def train_on(stream: DataFrame, train: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``train(batch, number)`` for each batch of feedback; a batch that is repeated comes with its old number."""
    return stream.writeStream.foreachBatch(train).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
