"""What a stream of events leaves outside: the state of jobs, metrics and messages to others, each batch once.

A batch writes into folders of its own number, in place of what a first try of it has left there; so a batch that is run
again after a failure adds nothing twice, and readers see a batch whole or not at all, as its files are committed together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events of a clone, by what they are about.
EVENTS = {
    "lifecycle": ("clone_start", "clone_complete", "clone_error"),
    "progress": ("page_loaded", "network_logs_extracted", "html_processing_start", "html_processing_complete", "css_processing_start", "css_processing_complete"),
    "download": ("resource_discovered", "resource_download_start", "resource_download_success", "resource_download_failed", "resource_download_skipped"),
    "statistics": ("stats_update", "file_type_stats_update"),
    "general": ("progress_update", "log_message"),
}
#: What the last lifecycle event of a job makes of it, and the events that others are told of.
STATUS = {"clone_start": "running", "clone_complete": "completed", "clone_error": "failed"}


def once(folder: str, of: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: of each batch the tables that `of` makes, by name, below folder. The batch is read once a table; a table without rows writes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, made in of.items():
                made(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return sink


def jobs(events: DataFrame) -> DataFrame:
    """(job, status, at, n) of the jobs that events (job, at, n, kind) tell of: the last lifecycle event decides."""
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("kind")]
    last = events.withColumn("status", status).where("status is not null").groupBy("job").agg(F.max(F.struct("at", "n", "status")).alias("last"))
    return last.select("job", "last.status", "last.at", "last.n")


def metrics(events: DataFrame) -> DataFrame:
    """(kind, count) of events."""
    return events.groupBy("kind").agg(F.count("*").alias("count"))


def webhooks(events: DataFrame) -> DataFrame:
    """(event, payload): a JSON message for each start, end and failure."""
    return events.where(F.col("kind").isin(*STATUS)).select(F.col("kind").alias("event"), F.to_json(F.struct("job", "n", F.col("kind").alias("event"))).alias("payload"))


def integrations(folder: str) -> Callable[[DataFrame, int], None]:
    """The three above, for foreachBatch."""
    return once(folder, {"jobs": jobs, "metrics": metrics, "webhooks": webhooks})


def left(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What all batches so far have left of a table: the latest of each job, sums of metrics, all messages."""
    rows = spark.read.parquet(f"{folder}/{name}")
    if name == "jobs":
        last = rows.groupBy("job").agg(F.max(F.struct("at", "n", "status")).alias("last"))
        return last.select("job", "last.status", "last.at", "last.n")
    return rows.groupBy("kind").agg(F.sum("count").alias("count")) if name == "metrics" else rows.select("event", "payload")
