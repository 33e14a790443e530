"""Job progress as a stream.

Each micro-batch is reduced to the newest status per item and stored under its batch number. A
replayed batch overwrites its own folder, so results are exact after a restart, and nothing is
held in state: the parts merge at read time like any partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldledger.operators import jobs


def start_progress_log(events: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow item status events (job_id, item, seq, status) and keep their log at ``log``."""

    def store(batch: DataFrame, number: int) -> None:
        jobs.latest_items(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_progress(spark: SparkSession, log: str) -> DataFrame:
    """Current progress of every job in the log."""
    return jobs.job_progress(jobs.merge_items(spark.read.parquet(log)))


def compact_progress_log(spark: SparkSession, log: str, compacted: str) -> None:
    """Write a log's merged state as the first batch of a new log."""
    jobs.merge_items(spark.read.parquet(log)).write.parquet(f"{compacted}/batch=-1")
