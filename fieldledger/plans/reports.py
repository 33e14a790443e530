"""Roll-ups and report tables over the evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldledger.operators import report, rollup, score
from fieldledger.operators.score import RUN
from fieldledger.plans.evaluation import eval_run_summary, invoice_pairs

SPECS = ("alpha:minimal", "beta", "gamma:high")


def multi_model_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weighted_rollup(eval_run_summary(spark, sf_dir)).drop("mean_cost_usd")


def base_vs_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rollup.weighted_rollup(eval_run_summary(spark, sf_dir))
    named = rollup.base_and_tuned(rolled, {"alpha": "alpha", "beta": "fine-tuned"})
    return named.select("label", "micro_f1", "macro_f1", "doc_exact_match", "n_docs", "errors")


def matrix_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared model in order, with dashes where it was never run."""
    combos = rollup.declared_combos(spark, SPECS)
    rolled = rollup.weighted_rollup(eval_run_summary(spark, sf_dir))
    compared = rollup.comparison(combos, rolled)
    return compared.select(
        F.col("pos").cast("bigint").alias("pos"),
        "label",
        F.coalesce("effort", F.lit(rollup.MISSING)).alias("effort"),
        F.coalesce(F.col("n_docs").cast("string"), F.lit("")).alias("docs_text"),
        F.when(F.col("n_docs").isNull(), rollup.MISSING)
        .otherwise(F.col("errors").cast("string"))
        .alias("errors_text"),
    )


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared runs (model by dataset) against the runs that exist."""
    combos = rollup.declared_combos(spark, SPECS)
    wanted = rollup.run_matrix(combos, [("invoice", d) for d in ("f", "o", "p", "x")])
    found = eval_run_summary(spark, sf_dir).select(
        "model", "effort", "dataset", "n_docs", F.lit(True).alias("has_run")
    )
    same = (
        (wanted["model"] == found["model"])
        & wanted["effort"].eqNullSafe(found["effort"])
        & (wanted["dataset"] == found["dataset"])
    )
    return wanted.join(found, same, "left").select(
        "label", "doc_type", wanted["dataset"], "n_docs", F.coalesce("has_run", F.lit(False)).alias("has_run")
    )


def report_field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = report.field_table(score.field_stats(invoice_pairs(spark, sf_dir), "invoice"))
    place = F.row_number().over(Window.partitionBy(*RUN).orderBy(*report.report_order()))
    return table.select(
        *RUN, place.cast("bigint").alias("place"), "field", "field_type", "tp", "fp", "fn", "tn", "support"
    )
