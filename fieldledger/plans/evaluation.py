"""Evaluation plans over the derived invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldledger.operators import score
from fieldledger.plans import invoices


def invoice_pairs(spark: SparkSession, sf_dir: str, runs=invoices.RUNS) -> DataFrame:
    pairs = score.pair_documents(
        invoices.truth_invoices(spark, sf_dir), invoices.predicted_invoices(spark, sf_dir), runs, invoices.KEY
    )
    return score.with_cost(pairs)


def eval_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_stats(invoice_pairs(spark, sf_dir), "invoice")


def eval_field_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.document_outcomes(invoice_pairs(spark, sf_dir), "invoice")


def eval_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.doc_stats(invoice_pairs(spark, sf_dir), "invoice")


def eval_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.micro_macro(score.field_counts(invoice_pairs(spark, sf_dir), "invoice"))
    return out.withColumn("macro_f1", F.round("macro_f1", 9))


def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = score.run_statistics(invoice_pairs(spark, sf_dir), "invoice")
    return score.run_summary(stats, "invoice")
