"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import stored

#: Runs of rows into which each shard is cut to number it; each is ranked by itself.
SLOT_RUNS = 1024
#: Key text of a null key, which no number has.
NULL_KEY = "null"


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def _hash52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """One score per shard; the record goes to the largest.

    With equal weights the hash itself is the score; else ``-weight / ln(u)`` of the hash as a
    fraction ``u``, which gives each shard its weight's share. A score depends on the key, the
    shard's number and its weight alone.
    """
    hashes = [_hash52(F.concat(key_text(key), F.lit(f"#{i}"))) for i in range(len(weights))]
    if len(set(weights)) == 1:
        return hashes
    return [
        F.lit(-float(w)) / F.ln((h.cast("double") + F.lit(0.5)) / F.lit(float(2**52)))
        for h, w in zip(hashes, weights, strict=True)
    ]


def best_shard(scores: Column, shards: int) -> Column:
    """Number of the largest of the first ``shards`` scores; the lower number wins a tie, so a
    shard that is added takes rows only into itself."""
    first = F.slice(scores, 1, shards)
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    weights: Sequence[float] | None = None,
    grown_weight: float | None = None,
) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    ``weights`` has one positive number per shard (default: all 1) and ``grown_weight`` that of the
    shard added for ``grown_shard`` (default: the last one's). size is the UTF-8 bytes of ``text``
    (null: none) plus 16; text_crc32 of a null text is that of an empty one. Null keys share one
    shard. ``slot`` numbers each shard from 0 without gaps, by run of rows, key, checksum and size;
    rows equal in all of these take either number. Texts are read once; only the narrow columns
    are shuffled, and no window holds more than a run. Other columns are not read.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("weights: one positive number per shard")
    grown = weights + [weights[-1] if grown_weight is None else grown_weight]
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.array(*shard_scores(F.col(key), grown)).alias("scores"),
    ).select(
        "key",
        "size",
        "text_crc32",
        best_shard(F.col("scores"), shards).alias("shard"),
        best_shard(F.col("scores"), shards + 1).alias("grown_shard"),
        (_hash52(F.concat(key_text(F.col("key")), F.lit("#run"), F.col("text_crc32").cast("string"))) % SLOT_RUNS)
        .cast("int")
        .alias("run"),
    )
    rows = stored(rows, "shards")
    # Rows before each run of its shard: at most shards x SLOT_RUNS rows.
    before = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = before.selectExpr(
        "shard",
        "run",
        "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
    )
    ranked = rows.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY shard, run ORDER BY key NULLS FIRST, text_crc32, size) - 1 AS place",
    )
    return ranked.join(before, ["shard", "run"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )


def with_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", weights: Sequence[float] | None = None) -> DataFrame:
    """``docs`` with all columns and ``shard``; nothing is shuffled."""
    weights = [1.0] * shards if weights is None else list(weights)
    return docs.withColumn("shard", best_shard(F.array(*shard_scores(F.col(key), weights)), shards))
