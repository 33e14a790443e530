"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.sources.storage import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's shared folder and read it back.

    Cuts the lineage and survives the loss of executors. The folder is new at each call and is
    left to the owner of ``spark.checkpoint.dir`` to expire.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, different in ``keys``: those of the smallest hash. Only hashes are sorted
    and sent; the rows stay where they are until they are chosen, and equal ones fold map-side."""
    hashed = rows.withColumn("__hash", F.xxhash64(*keys))
    chosen = hashed.select("__hash").distinct().orderBy("__hash").limit(limit)
    return hashed.join(F.broadcast(chosen), "__hash").dropDuplicates(["__hash"]).drop("__hash")


def label_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def text_slices(
    batches: Iterable[pd.DataFrame], column: str = "text", chars: int = 1_000_000, rows: int = 10_000
) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into runs of at most ``rows`` rows and about ``chars`` characters, so that
    what a task holds is bounded by these and the longest single text."""
    for batch in batches:
        batch = batch.assign(**{column: batch[column].fillna("")})
        if not len(batch):
            continue
        part = batch[column].str.len().cumsum().to_numpy() // chars + np.arange(len(batch)) // rows
        for _, piece in batch.groupby(part, sort=False):
            yield piece.reset_index(drop=True)


def arrow_slices(
    batches: Iterable[pa.RecordBatch], column: int = 1, chars: int = 1_000_000, rows: int = 10_000
) -> Iterator[pa.RecordBatch]:
    """The same for Arrow batches, by the bytes of a text column; nulls stay."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = sizes.astype(np.int64).cumsum() // chars + np.arange(batch.num_rows) // rows
        starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows].tolist()
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rid, label) after joining the classes of linked rows (a, b); a class is named by its
    smallest rid. Each turn hooks every class to the smallest one it touches."""
    while True:
        la = labels.select(F.col("rid").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("rid").alias("b"), F.col("label").alias("lb"))
        across = links.join(la, "a").join(lb, "b").filter("la <> lb")
        hooks = stored(
            across.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("to")), "hooks"
        )
        if hooks.isEmpty():
            return labels
        for _ in range(2):  # a class that is hooked to a hooked one goes on to that one's
            further = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(further, "to", "left").select("label", F.coalesce("further", "to").alias("to"))
        labels = stored(
            labels.join(hooks, "label", "left").select("rid", F.coalesce("to", "label").alias("label")), "labels"
        )


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
