"""Comparing models: document-weighted means over runs, and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.labels import combo_label, effort_of, model_of
from fieldledger.functions.numbers import fixed, percent, round_exact

# Decimal places of each rolled-up number.
WEIGHTED = {
    "micro_f1": 4,
    "macro_f1": 4,
    "doc_exact_match": 4,
    "mean_latency_ms": 0,
    "mean_cost_usd": 6,
}
SUMMED = {"total_cost_usd": 4, "wall_time_s": 2}
MISSING = "—"


def declared_combos(spark: SparkSession, specs: Sequence[str]) -> DataFrame:
    """``name[:effort]`` specs in their given order: pos, model, effort, label."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in specs])))
    return rows.select(
        "pos", model_of(F.col("col")).alias("model"), effort_of(F.col("col")).alias("effort")
    ).withColumn("label", combo_label(F.col("model"), F.col("effort")))


def run_matrix(combos: DataFrame, datasets: Sequence[tuple[str, str]]) -> DataFrame:
    """Every combo on every (doc_type, dataset); the dataset list is unfolded in place."""
    listed = F.array(
        *[F.struct(F.lit(t).alias("doc_type"), F.lit(d).alias("dataset")) for t, d in datasets]
    )
    return combos.select("*", F.inline(listed))


def weighted_rollup(
    summaries: DataFrame, keys: Sequence[str] = ("model", "effort"), wall_time: bool = False
) -> DataFrame:
    """One row per model: means weighted by documents, sums of errors and cost.

    This is not a pooled F1. Groups without any document are left out.
    """
    n = F.col("n_docs")

    def mean(name: str, places: int) -> Column:
        weighted = F.try_divide(F.sum(F.col(name) * n), F.sum(n))
        return round_exact(weighted, places).alias(name)

    sums = [c for c in SUMMED if c != "wall_time_s" or wall_time]
    return (
        summaries.groupBy(*keys)
        .agg(
            F.sum(n).alias("n_docs"),
            F.sum("errors").alias("errors"),
            *[mean(c, places) for c, places in WEIGHTED.items()],
            *[round_exact(F.sum(c), SUMMED[c]).alias(c) for c in sums],
        )
        .where(F.col("n_docs") > 0)
    )


def comparison(combos: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every declared combo with its numbers, nulls where there is no result."""
    results = rollup.withColumn("label", combo_label(F.col("model"), F.col("effort"))).drop(
        "model", "effort"
    )
    return combos.join(results, "label", "left")


def base_and_tuned(rollup: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows of the named models only, with their display label."""
    named: Column = F.lit(None).cast("string")
    for model, label in labels.items():
        named = F.when(F.col("model") == model, label).otherwise(named)
    return rollup.withColumn("label", named).where(F.col("label").isNotNull())


def _or_dash(shown: Column) -> Column:
    return F.coalesce(shown, F.lit(MISSING))


def markdown_rows(compared: DataFrame) -> DataFrame:
    """pos, line: the table row of each combo."""
    cells = [
        F.concat(F.lit("`"), F.col("model"), F.lit("`")),
        _or_dash(F.col("effort")),
        _or_dash(fixed(F.col("micro_f1"), 3)),
        _or_dash(fixed(F.col("macro_f1"), 3)),
        _or_dash(percent(F.col("doc_exact_match"), 0)),
        _or_dash(fixed(F.col("mean_latency_ms"), 0)),
        _or_dash(fixed(F.col("mean_cost_usd"), 5, "$")),
        _or_dash(fixed(F.col("total_cost_usd"), 4, "$")),
    ]
    return compared.select(
        "pos", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )


def csv_rows(compared: DataFrame) -> DataFrame:
    """The same numbers as plain text, blank where missing."""
    plain = [*WEIGHTED, "total_cost_usd", "n_docs", "errors"]
    return compared.select(
        "pos",
        "model",
        F.coalesce("effort", F.lit("")).alias("reasoning_effort"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in plain],
    )
