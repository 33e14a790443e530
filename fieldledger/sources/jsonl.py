"""JSON-lines in and out, split scans, and stable row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from fieldledger.functions.text import strip
from fieldledger.schemas import truth_row_type


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType
) -> DataFrame:
    """Rows of one or more JSON-lines files; blank lines are skipped, malformed lines fail."""
    given = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(given)


def read_truth(spark: SparkSession, paths: str | Sequence[str], doc_type: str) -> DataFrame:
    return read_jsonl(spark, paths, truth_row_type(doc_type))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines (column ``raw``) with ``pos``, their position among all lines.

    Blank lines are dropped after counting, so positions say where a record stands in the file.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    lines = with_positions(spark.read.text(given).withColumnRenamed("value", "raw"))
    return lines.where(strip(F.col("raw")) != "")


def with_positions(scan: DataFrame) -> DataFrame:
    """Add ``pos``: 0, 1, 2, … in file-name order, then in order within the file.

    ``scan`` must be a plain file scan. Rows are counted per file split and the counts summed
    up over the splits, so only one row per split is ever sorted; a row's position is its
    split's offset plus its place inside the split.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = tagged.groupBy("_file", "_block").agg(
        F.count("*").alias("n"), F.min("_row").alias("_from")
    )
    before = F.sum("n").over(
        Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = splits.select(
        "_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift")
    )
    return (
        tagged.join(offsets, ["_file", "_block"])
        .withColumn("pos", F.col("_row") + F.col("_shift"))
        .drop("_file", "_block", "_row", "_shift")
    )


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write id, source, ground_truth as JSON lines, nulls included; returns the row count."""
    counted = Observation()
    rows = df.select("id", "source", "ground_truth").observe(counted, F.count("*").alias("n"))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return counted.get["n"]


def load_split(
    spark: SparkSession, split: str, candidates: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """First staged dataset that can be opened: ``<candidate>/<split>`` as parquet or JSON."""
    failure: Exception | None = None
    for base in candidates:
        path = f"{base}/{split}"
        for load in (spark.read.parquet, None):
            try:
                if load is not None:
                    return load(f"{path}.parquet")
                reader = spark.read if schema is None else spark.read.schema(schema)
                return reader.json(f"{path}.jsonl")
            except AnalysisException as e:
                failure = e
    raise FileNotFoundError(f"no candidate could be loaded for split {split!r}") from failure


def concat_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    """Several inputs one after the other; columns missing from one of them are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
