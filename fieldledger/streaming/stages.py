"""Stage timing of requests as a stream.

The start of a stage is a minimum, so each micro-batch stores the first time of every (request,
stage) it has seen and the parts merge at read time, in whatever order events and batches arrive.
A replayed batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldledger.operators import jobs


def first_times(events: DataFrame) -> DataFrame:
    return events.groupBy("request_id", "stage").agg(F.min("ts").alias("ts"))


def start_stage_log(events: DataFrame, log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow stage events (request_id, stage, ts) and keep their first times at ``log``."""

    def store(batch: DataFrame, number: int) -> None:
        first_times(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        events.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_stage_timing(spark: SparkSession, log: str) -> DataFrame:
    """Elapsed time per stage of every request in the log; unfinished ones are ``open``."""
    return jobs.stage_timing(spark.read.parquet(log).drop("batch"))


def compact_stage_log(spark: SparkSession, log: str, compacted: str) -> None:
    """Write a log's merged state as the first batch of a new log."""
    first_times(spark.read.parquet(log)).write.parquet(f"{compacted}/batch=-1")
