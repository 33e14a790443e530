"""Batch-job progress and per-request stage timing from append-only events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The stages of one request in order.
STAGES = ("starting", "loading", "model_call", "validated", "result", "error", "done")

#: Items on a page of a job's snapshot.
PAGE_SIZE = 1000


def latest_items(events: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """job_id, item, status, seq, started: the newest status of every item.

    ``events``: job_id, item, seq, status (and ``extra`` columns). The result has the same
    shape as its input apart from ``started``, so results of parts can be merged by
    ``merge_items``.
    """
    newest = F.max_by(F.struct("status", *extra), "seq")
    return (
        events.groupBy("job_id", "item")
        .agg(
            newest.alias("newest"),
            F.max("seq").alias("seq"),
            F.bool_or(F.col("status") == "running").alias("started"),
        )
        .select("job_id", "item", "newest.*", "seq", "started")
    )


def merge_items(parts: DataFrame) -> DataFrame:
    return (
        parts.groupBy("job_id", "item")
        .agg(
            F.max_by("status", "seq").alias("status"),
            F.max("seq").alias("seq"),
            F.bool_or("started").alias("started"),
        )
        .select("job_id", "item", "status", "seq", "started")
    )


def job_status(total: Column, settled: Column, started: Column) -> Column:
    """Done once every item is settled (also when there is none), running once one started."""
    return F.when(settled == total, "done").when(started, "running").otherwise("pending")


def _progress() -> list[Column]:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return [
        F.count("item").alias("total"),
        n("done").alias("done"),
        n("error").alias("errors"),
        n("pending").alias("pending"),
        n("running").alias("running"),
        F.coalesce(F.bool_or("started"), F.lit(False)).alias("started"),
    ]


def job_progress(items: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Counts by status and the job's own status; ``jobs`` (job_id) adds jobs without items."""
    counted = items.groupBy("job_id").agg(*_progress())
    if jobs is not None:
        counted = jobs.select("job_id").join(counted, "job_id", "left")
        zero = {c: 0 for c in ("total", "done", "errors", "pending", "running")}
        counted = counted.fillna(zero).fillna({"started": False})
    status = job_status(F.col("total"), F.col("done") + F.col("errors"), F.col("started"))
    return counted.select(
        "job_id", "total", "done", "errors", "pending", "running", status.alias("status")
    )


def item_pages(items: DataFrame, extra: Sequence[str] = (), page_size: int = PAGE_SIZE) -> DataFrame:
    """job_id, page, items: a job's items in order, in pages by their index. Page k holds the items
    from k x ``page_size`` on, so no list is longer than a page, however large the job, and pages of
    one job are built in different tasks. All items are kept."""
    entry = F.struct(F.col("item").alias("index"), "status", *extra)
    page = F.floor(F.col("item") / page_size).cast("long")
    return items.groupBy("job_id", page.alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("items"))


def job_snapshots(
    items: DataFrame, extra: Sequence[str] = (), jobs: DataFrame | None = None, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Status and progress of each job beside each page of its items; a job without items (of
    ``jobs``) has one row without a page."""
    progress = job_progress(items, jobs).select(
        "job_id", "status", F.struct("total", "done", "errors", "pending", "running").alias("progress")
    )
    return progress.join(item_pages(items, extra, page_size), "job_id", "left")


def stage_times() -> list[Column]:
    """Start of each stage, as aggregates: they combine map-side, no window is needed."""
    return [F.min(F.when(F.col("stage") == s, F.col("ts"))).alias(s) for s in STAGES]


def elapsed_ms(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def with_elapsed(times: DataFrame) -> DataFrame:
    """Milliseconds from the start of the request to each stage, and the outcome."""
    stages = [
        elapsed_ms(F.col(s), F.col("starting")).alias(f"{s}_ms") for s in STAGES if s != "starting"
    ]
    others = [c for c in times.columns if c not in STAGES]
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("done").isNotNull(), "ok")
        .otherwise("open")
    )
    return times.select(*others, *stages, outcome.alias("outcome"))


def stage_timing(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Elapsed time at each stage of each request. ``events``: request id, stage, ts."""
    return with_elapsed(events.groupBy(key).agg(*stage_times()))
