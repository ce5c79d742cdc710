"""Structured Streaming twins of the job queries, over a stream of event files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as their Parquet files arrive, one file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type so far."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def first_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each type and job within the watermark: a listener that hears once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job, by (ts, event_id)."""
    state = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' ELSE 'cloning' END")
    return events.groupBy("user_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("status"))


def counts_by_window(events: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """An extension: events by type and event-time window, late ones beyond the delay dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over all that is there, handing each batch to sink, and returns when done."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


#: What a clone goes through, with the share done when each stage begins.
STAGES = {
    "start": 0, "driver_ready": 10, "folders_ready": 15, "page_loading": 20, "page_loaded": 22, "logs_read": 25, "html_read": 30, "assets_done": 70, "css_done": 75, "css_processed": 90, "complete": 100,
}


def progress(events: DataFrame, job: str = "job", stage: str = "stage", at: str = "at") -> DataFrame:
    """(job, percentage): the share done of each job by the latest of its known stages; jobs without one have none done."""
    share = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[F.col(stage)]
    return events.groupBy(F.col(job).alias("job")).agg(F.coalesce(F.max_by(share, F.when(share.isNotNull(), F.col(at))), F.lit(0)).alias("percentage"))


#: Levels of a log, lowest first.
LEVELS = ("TRACE", "DEBUG", "INFO", "SUCCESS", "WARNING", "ERROR", "CRITICAL")


def at_least(logs: DataFrame, level: str = "INFO", level_col: str = "level") -> DataFrame:
    """Messages of a level or above; unknown levels are left out."""
    return logs.where(F.upper(level_col).isin(*LEVELS[LEVELS.index(level) :]))
