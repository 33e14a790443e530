"""Receipt and filing evaluation, filing validation, and reads back of what the sinks write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.operators import filings, score, validate
from fieldledger.operators.score import RUN
from fieldledger.plans.evaluation import invoice_pairs
from fieldledger.plans.filings import filing_feed, reported_facts
from fieldledger.plans.invoices import build, table
from fieldledger.schemas import FILING, RECEIPT
from fieldledger.sources import jsonl, reports
from fieldledger.sources.documents import SUBMISSIONS_TYPE
from fieldledger.sources.storage import new_folder

RUNS = (("alpha", None),)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, dataset, date, total, name, priority of every order; every fourth total is large."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    large = F.when(F.col("o_orderkey") % 4 == 0, 2e10).otherwise(0.0)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"),
        F.lower("o_orderstatus").alias("dataset"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice") + large).alias("total"),
        F.col("c_name").alias("name"),
        F.col("o_orderpriority").alias("priority"),
    )


def _pairs(rows: DataFrame, truth: Column, data: Column) -> DataFrame:
    one = F.lit(None)
    doc = F.col("k").cast("string").alias("doc_id")
    predictions = rows.select(
        F.lit("alpha").alias("model"),
        one.cast("string").alias("effort"),
        "dataset",
        doc,
        data.alias("data"),
        one.cast("string").alias("error"),
        F.lit(1.0).alias("latency_ms"),
        F.lit(1).alias("input_tokens"),
        F.lit(1).alias("output_tokens"),
    )
    return score.pair_documents(rows.select("dataset", doc, truth.alias("truth")), predictions, RUNS)


def receipt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heads(spark, sf_dir)
    k, name, total = F.col("k"), F.col("name"), F.col("total")
    clock = F.format_string("%02d:%02d:00", (k % 24).cast("int"), (k % 60).cast("int"))

    def record(raw: bool) -> Column:
        wrong = F.lit(False) if raw else F.lit(True)
        typo = (
            F.when(k % 3 == 0, F.concat(name, F.lit("x")))
            .when(k % 11 == 0, F.substring(name, 1, 12))
            .when(k % 13 == 0, F.substring(name, 1, 15))
            .otherwise(name)
        )

        def items(group) -> Column:
            one = build(
                group, {"description": F.col("priority"), "quantity": (k % 3 + 1).cast("double"), "total": total}, raw
            )
            return F.when(wrong & (k % 17 == 0), F.array(one, one)).otherwise(F.array(one))

        date = F.col("date")
        return build(
            RECEIPT,
            {
                "merchant": F.when(wrong, typo).otherwise(name),
                "transaction_date": F.date_format(date, "yyyy-MM-dd") if raw else date,
                "transaction_time": F.when(wrong & (k % 5 == 0), "23:59:59").otherwise(clock),
                "receipt_number": F.concat(F.lit("r"), k.cast("string")),
                "line_items": items,
                "total": F.when(wrong & (k % 7 == 0), total * 1.01).otherwise(total),
                "tip": F.when(wrong & (k % 19 == 0), 1.5),
                "currency": F.lit("USD"),
                "payment_method": F.when(k % 2 == 0, F.when(wrong, " cash ").otherwise("CASH")),
            },
            raw,
        )

    return _pairs(rows, record(True), record(False))


def filing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heads(spark, sf_dir)
    k, total = F.col("k"), F.col("total")
    cik = F.lpad(k.cast("string"), 10, "0")

    def record(raw: bool) -> Column:
        wrong = F.lit(not raw)
        date = F.col("date")
        risks = (k % 6).cast("int")

        def items(group) -> Column:
            n = F.when(wrong & (k % 4 == 0), F.greatest(risks - 1, F.lit(0))).otherwise(risks)
            places = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < n)

            def one(i: Column) -> Column:
                title = F.concat(F.lit("supply risk "), i.cast("string"))
                theme = F.when(wrong & (k % 5 == 0) & (i == 0), F.lit("weather")).otherwise(title)
                return build(group, {"theme": theme, "summary": F.col("priority")}, raw)

            return F.transform(places, one)

        return build(
            FILING,
            {
                "cover": {
                    "company_name": F.when(wrong & (k % 3 == 0), F.upper("name")).otherwise(F.col("name")),
                    "cik": F.when(wrong & (k % 7 == 0), F.lit("0000000000")).otherwise(cik),
                    "form_type": F.lit("10-K"),
                    "fiscal_year_end": F.date_format(date, "yyyy-MM-dd") if raw else date,
                },
                "financials": {
                    "currency": F.lit("USD"),
                    "fiscal_year": F.when(wrong & (k % 9 == 0), F.year(date) + 1).otherwise(F.year(date)),
                    "revenue": F.when(wrong & (k % 8 == 0), total + 0.01).otherwise(total),
                    "net_income": F.when(wrong & (k % 10 == 0), None).otherwise(total / 4),
                },
                "top_risk_factors": items,
            },
            raw,
        )

    return _pairs(rows, record(True), record(False))


def eval_receipt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_stats(receipt_pairs(spark, sf_dir), "receipt")


def eval_filing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_stats(filing_pairs(spark, sf_dir), "filing")


def validate_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing envelopes with years out of range and too many risk factors, and their reasons."""
    k = F.col("o_orderkey")
    year = F.when(k % 11 == 0, 1899).when(k % 13 == 0, 2101).when(k % 7 == 0, None).otherwise(2020)
    risk = '{"theme":"t","summary":"s"}'
    data = F.concat(
        F.lit('{"data":{"cover":{"company_name":" Acme ","cik":"'),
        k.cast("string"),
        F.lit('"},"financials":{"currency":"usd"'),
        F.coalesce(F.concat(F.lit(',"fiscal_year":'), year.cast("string")), F.lit("")),
        F.lit(',"revenue":'),
        F.format_string("%.2f", F.col("o_totalprice") + 3e10),
        F.lit('},"top_risk_factors":['),
        F.array_join(F.array_repeat(F.lit(risk), (k % 8).cast("int")), ","),
        F.lit(']},"field_confidences":[],"warnings":[]}'),
    )
    # Checking an envelope costs far more than moving an order: a few splits would keep most cores idle.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(parts, "o_orderkey")
    rows = orders.select(k.cast("string").alias("doc_id"), data.alias("raw"))
    checked = validate.validate_envelopes(rows, "filing")
    return checked.select(
        "doc_id",
        F.array_join("reasons", ";").alias("reasons"),
        F.col("data.cover.cik").alias("cik"),
        F.col("data.cover.form_type").alias("form_type"),
        F.col("data.financials.currency").alias("currency"),
        F.col("data.financials.fiscal_year").cast("bigint").alias("fiscal_year"),
        F.col("data.financials.revenue").alias("revenue"),
        F.size("data.top_risk_factors").alias("n_risks"),
    )


# --- sinks and sources ---------------------------------------------------------------------------


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt truth written as JSON lines and read back with its schema."""
    path = new_folder(spark, "jsonl")
    pairs = receipt_pairs(spark, sf_dir)
    rows = pairs.select(F.col("doc_id").alias("id"), F.col("dataset").alias("source"), F.col("truth").alias("ground_truth"))
    n = jsonl.write_jsonl(rows, path)
    back = jsonl.read_truth(spark, path, "receipt")
    truth = "ground_truth."
    return back.select(
        "id",
        "source",
        F.col(truth + "merchant").alias("merchant"),
        F.col(truth + "transaction_date").cast("string").alias("transaction_date"),
        F.col(truth + "transaction_time").cast("string").alias("transaction_time"),
        F.col(truth + "total").alias("total"),
        F.col(truth + "tip").alias("tip"),
        F.col(truth + "line_items")[0]["quantity"].alias("quantity"),
        F.lit(n).cast("bigint").alias("n_written"),
    )


def summary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries written as reports and read back, the newest of each run folder."""
    path, kept = new_folder(spark, "summaries"), new_folder(spark, "counts")
    # A few rows per run, from one pass over the documents; everything in the report follows from them.
    score.run_counts(invoice_pairs(spark, sf_dir), "invoice").write.parquet(kept)
    counts = spark.read.parquet(kept)
    summary = score.run_summary(score.statistics_of(counts), "invoice")
    reports.write_summary(summary, score.field_rates(counts), "invoice", path, "2026-01-01T00:00:00+00:00")
    return reports.read_latest_summaries(spark, path).select(
        *RUN, "label", "n_docs", "errors", "micro_f1", "macro_f1", "doc_exact_match", "total_cost_usd"
    )


def per_record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rows of receipts written as CSV, one folder per run, read back and counted."""
    path = new_folder(spark, "per-record")
    pairs = score.with_cost(receipt_pairs(spark, sf_dir))
    reports.write_per_record(score.document_outcomes(pairs, "receipt"), "receipt", path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.groupBy("tag", "field", "field_type", "outcome").agg(F.count("*").alias("n"))


def submissions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of parallel arrays, one JSON text per issuer, unfolded to the newest annual filing."""
    entry = F.struct("place", "form", "accession", "filing_date", "primary_doc")
    listed = filing_feed(spark, sf_dir).groupBy("cik10").agg(F.array_sort(F.collect_list(entry)).alias("f"))
    recent = F.struct(
        F.col("f.form").alias("form"),
        F.col("f.accession").alias("accessionNumber"),
        F.col("f.filing_date").alias("filingDate"),
        F.col("f.filing_date").alias("reportDate"),
        F.col("f.primary_doc").alias("primaryDocument"),
    )
    doc = F.struct("cik10", F.lit("N").alias("name"), F.struct(recent.alias("recent")).alias("filings"))
    texts = listed.select(F.to_json(doc).alias("json"))
    feeds = texts.select(F.from_json("json", SUBMISSIONS_TYPE).alias("d")).select("d.*")
    newest = filings.latest_annual(filings.explode_submissions(feeds), "cik10")
    return newest.select("cik10", "company_name", "form", "accession", "filing_date", "primary_doc")


def facts_first_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested facts with two units and several entries each; the first usable value of each figure."""
    entry = F.struct(
        F.col("place.l_linenumber").alias("a"), F.col("place.l_partkey").alias("b"), F.col("place.l_quantity").alias("q"),
        F.col("place.l_extendedprice").alias("x"), "end", "form", "fp", "val",
    )
    # Entries, units and concepts are nested by stem in the end: one shuffle by stem serves all three groupings.
    facts = reported_facts(spark, sf_dir).withColumn("stem", F.col("place.l_orderkey")).repartition("stem")
    unit = F.when(F.col("place.l_partkey") % 3 == 0, "EUR").otherwise("USD")
    by_unit = facts.groupBy("stem", "concept", unit.alias("unit")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    plain = F.transform("e", lambda e: F.struct(e["end"].alias("end"), e["form"].alias("form"), e["fp"].alias("fp"), e["val"].alias("val")))
    by_concept = by_unit.groupBy("stem", "concept").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", plain.alias("entries"))))).alias("units")
    )
    by_filer = by_concept.groupBy("stem").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("concepts")
    )
    doc = F.struct(F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts"))
    parsed = by_filer.select("stem", F.to_json(doc).alias("json")).select(
        "stem", F.from_json("json", filings.FACTS_TYPE).alias("facts")
    )
    return filings.annual_values(filings.explode_facts(parsed, "stem"), "stem").select(
        F.col("stem").cast("bigint").alias("stem"), "end", "figure", F.col("rank").cast("bigint").alias("rank"), "val"
    )


QUERIES = {
    "eval_receipt_stats": eval_receipt_stats,
    "eval_filing_stats": eval_filing_stats,
    "validate_filings": validate_filings,
    "jsonl_roundtrip": jsonl_roundtrip,
    "summary_roundtrip": summary_roundtrip,
    "per_record_roundtrip": per_record_roundtrip,
    "submissions_latest": submissions_latest,
    "facts_first_unit": facts_first_unit,
}
