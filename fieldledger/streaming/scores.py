"""Scoring predictions as they arrive.

tp, fp, fn and tn are sums, so each micro-batch stores its own counts and the total is their
merge. Truth is a static table joined to every batch; store it once, in buckets of the key by which
both sides meet (``storage.bucketed``), and no batch moves it again.
Predictions without truth are kept as rejects. Truth without a prediction is counted when the
statistics are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldledger.operators import score
from fieldledger.operators.score import DOCUMENT, RUN, agreeing

_CALL = {"error": "string", "latency_ms": "double", "input_tokens": "bigint", "output_tokens": "bigint"}


def arrived(truth: DataFrame, predictions: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Predictions with their truth; what has not arrived is not judged yet."""
    shown = [predictions[c] for c in (*RUN, "doc_id", "error", "data")]
    return predictions.join(truth, agreeing(predictions, truth, DOCUMENT, key)).select(*shown, truth["truth"])


def unmatched(truth: DataFrame, predictions: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Predictions of documents that have no truth."""
    return predictions.join(truth, agreeing(predictions, truth, DOCUMENT, key), "left_anti")


def start_scoring(
    arriving: DataFrame,
    truth: DataFrame,
    doc_type: str,
    folder: str,
    checkpoint: str,
    key: Sequence[str] = DOCUMENT,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep counts, keys of what was seen, and rejects of every batch below ``folder``. ``key`` is that
    of ``score.pair_documents``.

    Predictions arrive, or documents of which ``predict`` makes them batch by batch: a batch does not
    say how the stream's plan has dealt its rows, so predictions dealt by ``key`` in that plan would
    move again for each join, and those made in the batch do not.
    """

    def store(rows: DataFrame, number: int) -> None:
        batch = rows if predict is None else predict(rows)
        blank = F.lit(None)
        seen = batch.select(
            *RUN,
            "doc_id",
            blank.cast(batch.schema["data"].dataType).alias("data"),
            *[blank.cast(kind).alias(name) for name, kind in _CALL.items()],
        )
        parts = {
            "counts": score.field_counts(arrived(truth, batch, key), doc_type),
            "seen": seen,
            "rejects": unmatched(truth, batch, key),
        }
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_field_stats(
    spark: SparkSession,
    folder: str,
    truth: DataFrame,
    doc_type: str,
    runs: Sequence[tuple[str, str | None]],
    key: Sequence[str] = DOCUMENT,
) -> DataFrame:
    """Field statistics of the declared runs over all of the truth, as a batch run gives them."""
    seen = spark.read.parquet(f"{folder}/seen").drop("batch")
    missing = score.pair_documents(truth, seen, runs, key).where("error = 'no prediction'")
    late = score.field_counts(missing.select(*RUN, "doc_id", "error", "data", "truth"), doc_type)
    counts = spark.read.parquet(f"{folder}/counts").select(*late.columns)
    return score.with_rates(score.merge_counts(counts.unionByName(late)))


def read_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rejects").drop("batch")
