"""Structured Streaming forms of the record-at-a-time writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from perkwise.operators.buckets import BucketedTable
from perkwise.operators.ingest import check_feedback_events
from perkwise.session import scratch_path


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_feedback_events(stream: DataFrame, received_at: str, delay: str = "1 day") -> DataFrame:
    """Valid feedback events, each request once within the delay."""
    valid = check_feedback_events(stream, received_at).valid
    return valid.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(
        ["customer_id", "request_id", "event_type"]
    )


def once(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Each row of a key once within the delay, so that a file that arrives again counts nothing twice."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(list(keys))


def rolling_feedback_stats(
    ratings: DataFrame, window: str = "7 days", slide: str = "1 day", delay: str | None = "1 hour"
) -> DataFrame:
    """Rating sums and thumb counts per sliding window.

    Appended to a sink, a window is emitted once it is complete; in a table kept by ``keep_feed`` open windows show too.
    Without a ``delay`` the stream has its watermark already, as after ``once``.
    """
    return (
        (ratings.withWatermark("created_at", delay) if delay else ratings)
        .groupBy(F.window("created_at", window, slide))
        .agg(
            F.sum("rating").alias("rating_sum"),
            F.count_if(F.col("thumbs") == "up").alias("ups"),
            F.count(F.lit(1)).alias("record_count"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "rating_sum", "ups", "record_count",
        )
    )


def call_metrics(calls: DataFrame, window: str = "1 minute", delay: str | None = "5 minutes") -> DataFrame:
    """Calls, latency and tokens per model and window; without a ``delay`` the stream has its watermark already."""
    return (
        (calls.withWatermark("created_at", delay) if delay else calls)
        .groupBy(F.window("created_at", window), "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("latency_ms").alias("latency_sum"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
        )
        .select(F.col("window.start").alias("window_start"), "model", "calls", "latency_sum",
                "prompt_tokens", "completion_tokens")
    )


def write_feed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, taking what is there now and stopping."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def keep_feed(
    stream: DataFrame, table: BucketedTable, order: Sequence[str], checkpoint: str, feed: str = "feed"
) -> StreamingQuery:
    """Keep a table up to date with a stream: every micro-batch replaces the rows of its keys, taking what is there now.

    The table shows open windows as they stand. A micro-batch is committed under its number, so one that a restart
    sends again after its commit changes nothing, and one that was lost before it is merged as if for the first time.
    """
    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, name=f"{feed}-{number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    write_feed(stream, path, scratch_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
