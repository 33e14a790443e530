"""Where intermediate data may be kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder (``spark.checkpoint.dir``).

    Only a local session that has none set gets a temporary one of its own, which is removed when
    the program ends; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="fieldledger-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The rows stored in one bucket per partition of a shuffle by ``key``: whatever meets them by
    ``key`` reads them where they lie, as often as it likes, and only the other side moves.

    Buckets are known to the catalogue alone; the name is dropped once the table is resolved, the
    files stay.
    """
    spark = rows.sparkSession
    n, path = partitions(spark), new_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    kept = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return kept
