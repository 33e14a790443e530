"""Job, stage and incremental-scoring queries over the event table, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldledger.operators import jobs, score
from fieldledger.plans import invoices
from fieldledger.sources.storage import bucketed, new_folder
from fieldledger.streaming import progress, scores, stages


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream."""
    schema = invoices.table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


def in_pieces(spark: SparkSession, rows: DataFrame, key: str, pieces: int = 3) -> DataFrame:
    """The rows as a stream of several files in mixed order, one file per batch."""
    path = new_folder(spark, "arriving")
    rows.repartition(pieces, F.xxhash64(key)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def item_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending")
        .when(kind == "purchase", "done")
        .when(kind == "error", "error")
        .otherwise("running")
    )
    return events.select(
        F.col("user_id").alias("job_id"),
        (F.col("event_id") % 20).alias("item"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
    )


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = item_events(invoices.table(spark, sf_dir, "events"))
    everyone = invoices.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return jobs.job_progress(jobs.latest_items(events), everyone)


def job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job and page of its items, in pages of the usual size."""
    snaps = jobs.job_snapshots(jobs.latest_items(item_events(invoices.table(spark, sf_dir, "events"))))
    listed = F.transform(
        "items", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x["status"])
    )
    return snaps.select(
        "job_id", "status", F.col("progress.total").alias("total"), "page", F.array_join(listed, ",").alias("items")
    )


def stage_events(events: DataFrame) -> DataFrame:
    slot = F.col("event_id") % 6
    stage = (
        F.when(slot == 0, "starting")
        .when(slot == 1, "loading")
        .when(slot == 2, "model_call")
        .when(slot == 3, F.when(F.col("event_type") == "error", "error").otherwise("validated"))
        .when(slot == 4, "result")
        .otherwise("done")
    )
    return events.select(
        F.expr("event_id div 6").alias("request_id"),
        stage.alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_timing(stage_events(invoices.table(spark, sf_dir, "events")))


def job_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, checkpoint = new_folder(spark, "progress"), new_folder(spark, "offsets")
    events = item_events(stream(spark, sf_dir, "events"))
    progress.start_progress_log(events, log, checkpoint).awaitTermination()
    return progress.read_progress(spark, log)


def stage_timing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in mixed order over several batches; the log merges to the batch result."""
    log, checkpoint = new_folder(spark, "stages"), new_folder(spark, "offsets")
    events = in_pieces(spark, invoices.table(spark, sf_dir, "events"), "event_id")
    stages.start_stage_log(stage_events(events), log, checkpoint).awaitTermination()
    return stages.read_stage_timing(spark, log)


def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions arrive as a stream of orders; counts merge to the batch result."""
    folder, checkpoint = new_folder(spark, "scores"), new_folder(spark, "offsets")
    # Lines and truth do not change while orders arrive: both are made once and lie by document.
    lists = bucketed(invoices.order_lists(spark, sf_dir), "lines", "list_id")
    truth = bucketed(invoices.truth_invoices(spark, sf_dir, lists), "truth", "doc_id")
    orders = in_pieces(spark, invoices.table(spark, sf_dir, "orders"), "o_orderkey")
    scores.start_scoring(
        orders, truth, "invoice", folder, checkpoint, invoices.KEY,
        predict=lambda batch: invoices.predicted_invoices(spark, sf_dir, batch, lists),
    ).awaitTermination()
    stats = scores.read_field_stats(spark, folder, truth, "invoice", invoices.RUNS, invoices.KEY)
    return stats.select(*score.RUN, "path", "tp", "fp", "fn", "tn", "support", "f1")
