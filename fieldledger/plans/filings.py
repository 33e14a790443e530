"""Filing facts, feeds and ground truth derived from line items, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.labels import archive_url, filing_stem
from fieldledger.operators import filings
from fieldledger.plans.invoices import table
from fieldledger.plans.receipts import choose

CONCEPTS = [c for concepts in filings.FIGURES.values() for c in concepts]


def reported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment row as one reported value of its supplier."""
    pick = (
        F.ascii("l_returnflag") * 7 + F.ascii("l_linestatus") * 3 + F.col("l_linenumber") * 5
    ) % len(CONCEPTS)
    names = F.array(*[F.lit(c) for c in CONCEPTS])
    year = F.year("l_shipdate").cast("string")
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stem"),
        F.get(names, pick).alias("concept"),
        F.concat(year, F.lit("-12-31")).alias("end"),
        choose(k, F.lit("10-K"), F.lit("10-Q"), F.lit("10-K/A")).alias("form"),
        choose(F.col("l_partkey"), F.lit("FY"), F.lit("Q3")).alias("fp"),
        F.when(k % 13 == 0, "n/a").otherwise(F.format_string("%.2f", "l_extendedprice")).alias("val"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
        ).alias("place"),
    )


def period_end() -> Column:
    return F.concat((F.lit(1996) + F.col("s_suppkey") % 5).cast("string"), F.lit("-12-31"))


def supplier_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = filings.annual_values(reported_facts(spark, sf_dir), "stem", F.col("place"))
    periods = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("stem"), period_end().alias("fy_end")
    )
    return filings.financials(values, periods, "stem")


def xbrl_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = supplier_figures(spark, sf_dir)
    return figures.withColumn("total_debt", F.round("total_debt", 2))


def nested_facts_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as the nested JSON a filer publishes, one small document per order line."""
    r = reported_facts(spark, sf_dir)
    entry = F.struct("end", "form", "fp", "val")
    units = F.struct(F.create_map(F.lit("USD"), F.array(entry)).alias("units"))
    doc = F.struct(F.create_map(F.lit("us-gaap"), F.create_map("concept", units)).alias("facts"))
    published = r.select("stem", F.to_json(doc).alias("json"))
    parsed = published.select(
        "stem", F.from_json("json", filings.FACTS_TYPE).alias("facts")
    )
    long = filings.explode_facts(parsed, "stem")
    return long.groupBy("stem", "concept").agg(
        F.count("*").alias("n"),
        F.sum(F.col("val").try_cast("decimal(15,2)")).cast("double").alias("total"),
    )


def filing_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their customer, newest first."""
    form = (
        F.when(F.col("o_orderstatus") == "F", "10-K")
        .when(F.col("o_orderstatus") == "O", "10-Q")
        .otherwise("10-K/A")
    )
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik10"),
        form.alias("form"),
        F.concat(F.lit("0000-"), F.lpad(k, 8, "0"), F.lit("-26")).alias("accession"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
        F.concat(F.lit("d"), k, F.lit(".htm")).alias("primary_doc"),
        F.struct(-F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")),
                 F.col("o_orderkey")).alias("place"),
    )


def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = filings.latest_annual(filing_feed(spark, sf_dir), "cik10", F.col("place"))
    return newest.select(
        "cik10",
        "form",
        "filing_date",
        archive_url(F.col("cik10"), F.col("accession"), F.col("primary_doc")).alias("source_url"),
        filing_stem(F.lit("abc"), F.col("filing_date")).alias("stem"),
    )


def resolve_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    index = filings.ticker_index(
        supplier.select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_suppkey").alias("cik_str"),
        )
    )
    wanted = part.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("ticker"))
    known, unknown = filings.resolve_tickers(wanted, index)
    return known.unionByName(unknown, allowMissingColumns=True)


def filing_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    latest = supplier.select(
        key.alias("stem"),
        F.concat(F.lit("s"), key.cast("string")).alias("ticker"),
        F.lpad(key.cast("string"), 10, "0").alias("cik10"),
        F.col("s_name").alias("company_name"),
        F.lit("10-K").alias("form"),
        F.lit("0001-22-333").alias("accession"),
        F.lit("2002-02-01").alias("filing_date"),
        period_end().alias("reporting_period_end"),
        F.lit("x.htm").alias("primary_doc"),
        F.when(key % 3 == 0, "NYSE").when(key % 3 == 1, "").alias("exchange"),
        F.when(key % 2 == 0, "DE").otherwise("").alias("state_of_incorporation"),
        F.lit("Delaware").alias("state_of_incorporation_desc"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "text")
    notes = filings.sidecar(
        latest,
        docs.select(
            F.lpad(F.col("stem").cast("string"), 10, "0").alias("cik10"),
            "text",
            F.lit(True).alias("has_companyfacts"),
        ),
    ).withColumn("stem", F.col("cik10").cast("bigint"))
    truth = filings.filing_truth(docs, notes, supplier_figures(spark, sf_dir))
    cover, money = "ground_truth.cover.", "ground_truth.financials."
    return truth.select(
        "id",
        "source",
        F.md5("text").alias("digest"),
        F.col(cover + "cik").alias("cik"),
        F.col(cover + "exchange").alias("exchange"),
        F.col(cover + "state_of_incorporation").alias("state"),
        F.col(cover + "fiscal_year_end").alias("fiscal_year_end"),
        F.col(money + "fiscal_year").alias("fiscal_year"),
        F.col(money + "revenue").alias("revenue"),
        F.round(money + "total_debt", 2).alias("total_debt"),
        F.col(money + "free_cash_flow").alias("free_cash_flow"),
        F.size("ground_truth.top_risk_factors").alias("n_risks"),
    )


def filing_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar records of the newest filings, their text length from the documents."""
    newest = filings.latest_annual(
        filing_feed(spark, sf_dir)
        .withColumn("reporting_period_end", F.col("filing_date"))
        .withColumn("company_name", F.concat(F.lit("C"), F.col("cik10")))
        .withColumn("exchange", F.lit("NYSE"))
        .withColumn("state_of_incorporation", F.lit("DE"))
        .withColumn("state_of_incorporation_desc", F.lit("Delaware")),
        "cik10",
        F.col("place"),
    ).withColumn("ticker", F.concat(F.lit("t"), F.col("cik10")))
    texts = table(spark, sf_dir, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("cik10"),
        "text",
        (F.col("doc_id") % 2 == 0).alias("has_companyfacts"),
    )
    return filings.sidecar(newest, texts).select(
        "ticker", "cik10", "accession", "source_url", "text_bytes", "has_companyfacts", "exchange"
    )
