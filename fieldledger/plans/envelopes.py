"""Raw extractor output derived from orders, with every kind of defect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldledger.operators import infer, score, validate
from fieldledger.operators.flatten import flatten_rows
from fieldledger.plans import invoices
from fieldledger.schemas import INVOICE


def _item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, items: the order's items as JSON texts, by line number."""
    part = invoices.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = invoices.order_lines(spark, sf_dir).join(part, F.col("partkey") == F.col("p_partkey"), "left")
    k = F.col("l_orderkey")
    item = F.to_json(
        F.struct(
            F.col("p_name").alias("description"),
            F.col("partkey").cast("string").alias("sku"),
            F.when(k % 49 == 0, -1.0).otherwise(F.col("quantity")).alias("quantity"),
            F.col("amount").alias("total"),
            F.when(k % 51 == 0, 1.5).otherwise(F.col("tax_rate")).alias("tax_rate"),
        )
    )
    rows = lines.select("l_orderkey", F.struct("l_linenumber", item.alias("item")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x"))["item"].alias("items"))


def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, raw: one envelope per order."""
    k = F.col("o_orderkey")
    total = F.format_string("%.2f", "o_totalprice")
    number = k.cast("string")
    vendor = F.when(k % 53 == 0, '"vendor":{"email":"a@b.c"}').when(
        k % 55 == 0, '"vendor":{"name":"Northwind","site":"x"}'
    ).otherwise('"vendor":{"name":" Northwind "}')
    pieces = [
        F.when(k % 63 == 0, F.concat(F.lit('"invoice_number":'), number)).otherwise(
            F.concat(F.lit('"invoice_number":"'), number, F.lit('"'))
        ),
        vendor,
        F.when(k % 3 == 0, '"customer":null'),
        F.concat(
            F.lit('"line_items":['),
            F.coalesce(F.array_join("items", ","), F.lit("")),
            F.lit("]"),
        ),
        F.when(k % 35 == 0, None)
        .when(k % 39 == 0, '"total":-1')
        .when(k % 46 == 0, F.concat(F.lit('"total":"'), total, F.lit('"')))
        .when(k % 47 == 0, '"total":"abc"')
        .otherwise(F.concat(F.lit('"total":'), total)),
        F.when(k % 44 == 0, '"currency":"  usd "').otherwise('"currency":"EUR"'),
        F.when(k % 57 == 0, '"due_date":"2020-13-45"').when(k % 2 == 0, '"due_date":"2020-02-29"'),
        F.when(k % 33 == 0, '"foo":1'),
    ]
    score_text = F.when(k % 59 == 0, "1.2").otherwise("0.5")
    severity = F.when(k % 61 == 0, "fatal").otherwise("warning")
    raw = F.concat(
        F.lit('{"data":{'),
        F.concat_ws(",", *pieces),
        F.lit('},"field_confidences":[{"field":"total","score":'),
        score_text,
        F.lit('},{"field":"currency","score":0.25}],"warnings":[{"message":"m","severity":"'),
        severity,
        F.lit('"}]}'),
    )
    raw = F.when(k % 31 == 0, '{"data": {').otherwise(raw)
    text = F.when(k % 5 != 0, F.concat(F.lit("order "), number))
    orders = invoices.table(spark, sf_dir, "orders").join(
        _item_texts(spark, sf_dir), k == F.col("l_orderkey"), "left"
    )
    return orders.select(number.alias("doc_id"), text.alias("text"), raw.alias("raw"))


def validate_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_envelopes(raw_envelopes(spark, sf_dir), "invoice")
    results = validate.extraction_results(validate.accepted(checked), "invoice")
    return results.select(
        "doc_id",
        "document_type",
        F.col("data.vendor.name").alias("vendor"),
        F.col("data.total").alias("total"),
        F.col("data.currency").alias("currency"),
        F.col("data.due_date").alias("due_date"),
        F.size("data.line_items").alias("n_items"),
        "overall_confidence",
        F.size("warnings").alias("n_warnings"),
        "raw_text_snippet",
    )


def validate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_envelopes(raw_envelopes(spark, sf_dir), "invoice")
    return validate.rejected(checked).select(
        "doc_id", F.array_join("reasons", ";").alias("reasons")
    )


def flatten_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten_rows(invoices.truth_invoices(spark, sf_dir), "truth", INVOICE, raw=True)
    return rows.where("v_str IS NOT NULL OR v_num IS NOT NULL").select(
        "doc_id", "path", "ftype", "shown"
    )


def selfcheck_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = invoices.truth_invoices(spark, sf_dir)
    predictions = infer.selfcheck_predictions(truth, "invoice")
    pairs = score.pair_documents(truth, predictions, [("selfcheck", None)])
    stats = score.field_stats(pairs, "invoice")
    return stats.select("dataset", "path", "tp", "fp", "fn", "tn", "f1")


def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = score.with_cost(
        invoices.predicted_invoices(spark, sf_dir), {"beta": (0.001, 0.002)}
    ).where("error IS NULL")
    shown = score.metrics_view(calls.withColumn("exact_cost", F.col("cost_usd")), "doc_id", "exact_cost")
    return shown.drop("cost_usd")
