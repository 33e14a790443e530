"""Running a user-supplied extractor over partitions.

The extractor is any callable ``record -> result``. It is made once per partition (clients and
model handles live there), an exception becomes the record's ``error``, and retryable failures
are tried again with growing pauses.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldledger.functions.text import blank_to_null

# Retry limits, pauses in seconds, and the cap on concurrent calls.
MAX_ATTEMPTS = 3
FIRST_PAUSE = 1.0
LONGEST_PAUSE = 10.0

RESULT_FIELDS = [
    T.StructField("raw", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


class Retryable(Exception):
    """Raise this from an extractor when the same call may succeed later."""


def call_with_retry(
    extract: Callable[[dict], dict],
    record: dict,
    attempts: int = MAX_ATTEMPTS,
    pause: Callable[[float], Any] = time.sleep,
) -> dict:
    wait = FIRST_PAUSE
    for attempt in range(1, attempts + 1):
        try:
            return extract(record)
        except Retryable:
            if attempt == attempts:
                raise
            pause(wait)
            wait = min(wait * 2, LONGEST_PAUSE)
    raise AssertionError("unreachable")


def run_extractor(
    records: DataFrame,
    make_extractor: Callable[[], Callable[[dict], dict]],
    keep: list[str],
    attempts: int = MAX_ATTEMPTS,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """The ``keep`` columns of every record with raw, model, tokens, latency_ms and error.

    Calls in flight are as many as tasks run at once. ``profile`` bounds them for this stage (a
    task that asks for more CPUs leaves room for fewer), without moving the input into a few
    tasks. Filter before calling this: nothing is pushed through the Python stage.
    """
    schema = T.StructType([records.schema[c] for c in keep] + RESULT_FIELDS)
    names = [f.name for f in RESULT_FIELDS]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()

        def one(record: dict) -> dict:
            started = time.perf_counter()
            try:
                out = dict(call_with_retry(extract, record, attempts))
                out.setdefault("latency_ms", (time.perf_counter() - started) * 1000)
                return out
            except Exception as failure:  # isolated per record by design
                return {"error": str(failure)}

        for frame in frames:
            results = [one(r) for r in frame.to_dict("records")]
            columns = {c: frame[c] for c in keep}
            for name in names:
                values = [r.get(name) for r in results]
                columns[name] = pd.Series(values, index=frame.index, dtype=object)
            yield pd.DataFrame(columns)

    return records.mapInPandas(batches, schema, profile=profile)


def resolve_documents(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Decide what each record is extracted from: its file, else its inline text.

    ``files``: path, content. Adds filename, content and ``error`` for records that have
    neither, or whose file does not exist.
    """
    path, text = blank_to_null(F.col("file_path")), blank_to_null(F.col("text"))
    has_file = path.isNotNull()
    inline_name = F.concat(F.coalesce("id", F.lit("inline")), F.lit(".txt"))
    if files is None:
        joined = records.withColumn("content", F.lit(None).cast("binary"))
        found: Column = F.lit(False)
    else:
        known = files.select(
            F.regexp_replace("path", "^file:/*(?=/)", "").alias("_path"),
            F.col("content"),
            F.lit(True).alias("_found"),
        )
        joined = records.join(known, path == F.col("_path"), "left")
        found = F.coalesce("_found", F.lit(False))
    problem = F.when(has_file & ~found, F.concat(F.lit("file_path not found: "), path)).when(
        ~has_file & text.isNull(), "record has neither file_path nor text"
    )
    return joined.select(
        *records.columns,
        F.when(has_file, F.element_at(F.split(path, "/"), -1)).otherwise(inline_name).alias(
            "filename"
        ),
        F.when(has_file, F.col("content")).otherwise(F.encode(text, "UTF-8")).alias("content"),
        problem.alias("error"),
    )


def selfcheck_predictions(truth: DataFrame, doc_type: str) -> DataFrame:
    """Validated truth as its own prediction, at no cost; scoring it must give F1 = 1.

    ``truth``: dataset, doc_id, truth. Truth that fails validation is a failed document, with
    the reasons as its error.
    """
    from fieldledger.operators.validate import validate_envelopes

    empty = F.array().cast("array<string>")
    raw = F.to_json(
        F.struct(
            F.col("truth").alias("data"),
            empty.alias("field_confidences"),
            empty.alias("warnings"),
        ),
        {"ignoreNullFields": "true"},
    )
    checked = validate_envelopes(truth.withColumn("raw", raw), doc_type)
    return checked.select(
        F.lit("selfcheck").alias("model"),
        F.lit(None).cast("string").alias("effort"),
        "dataset",
        "doc_id",
        "data",
        F.when(F.size("reasons") > 0, F.concat_ws("; ", "reasons")).alias("error"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(0).alias("input_tokens"),
        F.lit(0).alias("output_tokens"),
    )
