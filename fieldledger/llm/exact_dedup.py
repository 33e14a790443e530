"""Exact duplicates with a heavy-hitter split.

Misra-Gries counter summaries name the digests that may be frequent; their exact counts verify
them, and the verified ones, at most ``HEAVY_LIMIT`` rows, are broadcast so that their copies are
settled map-side. All other digests are grouped and joined by an ordinary shuffle, in which no
group holds more than a thousandth of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import stored

#: Counters of one summary: every digest with more than 1 / 1536 of the rows keeps one.
COUNTERS = 2048
#: A digest is heavy if it has over 1 / HEAVY_LIMIT of the rows; so there are fewer than that.
HEAVY_LIMIT = 1000
#: Summaries of partitions are merged in so many groups first, then into one.
MERGE_GROUPS = 256


def _group() -> list[Column]:
    """Size of a group, its largest id, and one row that has it (any row where all ids are null)."""
    return [
        F.count("*").alias("group_size"),
        F.max("id").alias("keep_id"),
        F.coalesce(F.max_by("rid", "id"), F.max("rid")).alias("keep_rid"),
    ]


def frequent_digests(rows: DataFrame) -> DataFrame:
    """Verified heavy digests: digest, group_size, keep_id, keep_rid. At most HEAVY_LIMIT."""
    total = rows.count()
    partial = rows.groupBy(F.expr(f"pmod(spark_partition_id(), {MERGE_GROUPS})").alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("summary")
    )
    candidates = (
        # Grouped, since a partition without summaries can't be merged.
        partial.groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(summary, {HEAVY_LIMIT})")).alias("top"))
        .select(F.col("top.item").alias("digest"))
    )
    return (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(*_group())
        .filter((F.col("group_size") > 1) & (F.col("group_size") * HEAVY_LIMIT > total))
    )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``text`` is the normalised text (default: the column ``text``). Null counts as empty. Of rows
    with equal texts the one with the largest id stays (a null id is the smallest); of rows that
    also share the id, exactly one. Other columns are not read; an empty table gives no rows.
    """
    text = F.col("text") if text is None else text
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    heavy = stored(frequent_digests(rows), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    settled = marked.filter(F.col("keep_rid").isNotNull())
    rest = marked.filter(F.col("keep_rid").isNull()).select("digest", "id", "rid")
    copies = rest.groupBy("digest").agg(*_group()).filter(F.col("group_size") > 1)
    ordinary = rest.join(copies, "digest", "left").select(
        "digest",
        "id",
        "rid",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("keep_rid").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_rid", "rid").alias("keep_rid"),
    )
    return settled.select(*ordinary.columns).unionByName(ordinary).select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
