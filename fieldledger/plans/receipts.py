"""Raw receipt annotations derived from orders, in every shape the normalisers know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.numbers import DATE_LAYOUTS, parse_date, parse_money, round_exact
from fieldledger.functions.text import clean_text, filing_currency, pad_cik, upper_code
from fieldledger.operators import receipts
from fieldledger.plans.invoices import order_heads, table
from fieldledger.sources.jsonl import concat_inputs, with_positions


def choose(key: Column, *options: Column) -> Column:
    """Option number ``key mod len(options)``."""
    out = F.lit(None)
    for i, option in enumerate(options):
        out = F.when(key % len(options) == i, option).otherwise(out)
    return out


def money_text(key: Column, amount: Column) -> Column:
    plain = F.format_string("%.2f", amount)
    grouped = F.format_number(amount, 2)
    whole = F.floor(amount)
    return choose(
        key,
        F.concat(F.lit("$"), grouped),
        F.translate(grouped, ",.", ".,"),
        F.concat(F.lit("SGD "), plain),
        F.translate(plain, ".", ","),
        F.lit("total:"),
        F.concat(plain, F.lit(" USD")),
        F.concat(F.lit("£"), whole.cast("string")),
        F.format_number(whole.cast("double"), 0),
        F.concat(F.lit("("), grouped, F.lit(")")),
    )


def date_text(key: Column, date: Column) -> Column:
    written = [
        "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "MM/dd/yyyy",
        "dd-MM-yy", "dd/MM/yy", "MMM dd, yyyy", "MMMM dd, yyyy", "dd MMM yyyy", "dd MMMM yyyy",
        "yyyyMMdd",
    ]
    assert len(written) == len(DATE_LAYOUTS)
    options = [F.date_format(date, w) for w in written]
    return choose(key, *options, F.date_format(date, "MM/dd/yy"), F.lit("nonsense"))


def parse_money_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = money_text(F.col("o_orderkey"), F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("*", parse_money(F.col("raw")).alias("amount"))


def parse_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = date_text(F.col("o_orderkey"), F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("*", parse_date(F.col("raw")).alias("parsed"))


def clean_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("bigint").alias("n_chars")
    )


def currency_cik_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    code = F.when(key % 5 == 0, "   ").otherwise(
        F.concat(F.lit("  "), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit("\t"))
    )
    digits = key.cast("string")
    cik = choose(
        key,
        digits,
        F.concat(F.lit(" "), digits, F.lit("\n")),
        F.concat(F.lit("CIK"), digits),
        F.concat(F.lit("990000000000"), digits),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        upper_code(code).alias("currency"),
        filing_currency(code).alias("filing_currency"),
        pad_cik(cik).alias("cik"),
    )


# --- flat receipts ------------------------------------------------------------------------------


def flat_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, raw: one annotation per order."""
    k = F.col("o_orderkey")
    heads = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .withColumn("total_text", money_text(k, F.col("o_totalprice")))
        .withColumn("date_text", date_text(k, F.to_date("o_orderdate")))
    )
    company = F.when(k % 43 == 0, " \t").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    address = F.when(k % 4 != 0, F.concat(k.cast("string"), F.lit("  Main \t Street ")))

    def body(company_key: str, total_key: str, total: Column) -> Column:
        return F.to_json(
            F.struct(
                F.when(k % 3 == 0, F.concat(F.lit("R-"), k.cast("string"))).alias("id"),
                company.alias(company_key),
                address.alias("address"),
                F.col("date_text").alias("date"),
                total.alias(total_key),
            )
        )

    flat = body("company", "total", F.col("total_text"))
    other = body("merchant", "amount", F.when(k % 37 == 0, -5.0).otherwise(F.col("o_totalprice")))
    quoted = F.to_json(F.struct(flat.alias("ground_truth")))
    raw = choose(
        k,
        flat,
        F.concat(F.lit('{"parsed_data":'), flat, F.lit("}")),
        quoted,
        F.concat(F.lit('{"ground_truth":'), other, F.lit("}")),
        other,
    )
    raw = F.when(k % 41 == 0, "{broken").when(k % 47 == 0, '{"ground_truth":[1]}').otherwise(raw)
    return heads.select(k.alias("pos"), raw.alias("raw"))


def _flat_rows(normalized: DataFrame) -> DataFrame:
    g = "ground_truth."
    return normalized.select(
        "id",
        "source",
        F.col(g + "merchant").alias("merchant"),
        F.col(g + "merchant_address.line1").alias("line1"),
        F.col(g + "transaction_date").alias("transaction_date"),
        F.size(g + "line_items").alias("n_items"),
        F.aggregate(
            F.coalesce(F.col(g + "line_items"), F.array()),
            F.lit(0).cast("decimal(20,2)"),
            lambda acc, x: (acc + F.coalesce(x["total"], F.lit(0.0)).cast("decimal(18,2)")).cast(
                "decimal(20,2)"
            ),
        )
        .cast("double")
        .alias("items_total"),
        F.col(g + "subtotal").alias("subtotal"),
        F.col(g + "total").alias("total"),
        F.col(g + "currency").alias("currency"),
        "reason",
    )


def normalize_receipts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_rows(receipts.normalize_flat(flat_annotations(spark, sf_dir)))


# --- menu receipts ------------------------------------------------------------------------------


def menu_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, raw: one annotation per order, its lines as the menu."""
    k = F.col("o_orderkey")

    def entry(x: Column) -> Column:
        line = x["l_linenumber"]
        count = x["quantity"]
        return F.struct(
            F.when(line == 5, "  ").otherwise(F.concat(F.lit(" "), x["p_name"])).alias("nm"),
            F.when(k % 59 == 0, F.lit("-1"))
            .when(line == 3, F.lit("2 x"))
            .otherwise(F.format_string("%.0f", count))
            .alias("cnt"),
            F.when(line % 2 == 0, F.format_number(x["amount"] / 2, 2)).alias("unitprice"),
            F.format_number(x["amount"], 2).alias("price"),
        )

    menu = F.transform(F.coalesce("lines", F.array()), entry)
    single = F.to_json(F.get(menu, F.lit(0)))
    menu_json = F.when(F.size(menu) == 1, single).otherwise(F.to_json(menu))
    total_json = F.when(k % 53 == 0, '{"cashprice":"n/a"}').otherwise(
        F.concat(
            F.when(k % 2 == 0, '{"total_price":"').otherwise('{"total_price":"","cashprice":"'),
            F.format_number("o_totalprice", 2),
            F.lit('"}'),
        )
    )
    parts = [
        F.when(k % 10 != 7, F.concat(F.lit('"menu":'), menu_json)),
        F.when(
            k % 6 != 0,
            F.concat(
                F.lit('"sub_total":{"subtotal_price":"'),
                F.format_string("%.2f", "o_totalprice"),
                F.lit('"}'),
            ),
        ),
        F.when(k % 8 == 0, F.concat(F.lit('"merchant":"'), F.col("c_name"), F.lit('"'))),
        F.concat(F.lit('"total":'), total_json),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    wrapped = F.concat(F.lit('{"gt_parse":'), body, F.lit("}"))
    raw = choose(
        k,
        wrapped,
        F.to_json(F.struct(wrapped.alias("ground_truth"))),
        F.concat(F.lit('{"ground_truth":{"valid_line":'), body, F.lit("}}")),
        body,
    )
    raw = F.when(k % 61 == 0, '{"ground_truth":"{oops"}').otherwise(raw)
    return order_heads(spark, sf_dir).select(k.alias("pos"), raw.alias("raw"))


def normalize_receipts_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_rows(receipts.normalize_menu(menu_annotations(spark, sf_dir)))


def prepared_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources together: usable rows and rejects by source and reason."""
    both = concat_inputs(
        [
            receipts.normalize_flat(flat_annotations(spark, sf_dir)),
            receipts.normalize_menu(menu_annotations(spark, sf_dir)),
        ]
    )
    return both.groupBy("source", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(
        F.count("*").alias("n_rows")
    )


def first_flat_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 usable receipts in input order."""
    normalized = receipts.normalize_flat(flat_annotations(spark, sf_dir))
    return receipts.first_usable(normalized, 100).select("pos", "id")


def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every order in its table's file."""
    placed = with_positions(table(spark, sf_dir, "orders").select("o_orderkey", "_metadata"))
    return placed.select("o_orderkey", F.col("pos").cast("bigint").alias("pos"))


def round_exact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts from 1e10 to 1e13 with ties at the third decimal, by order."""
    k = F.col("o_orderkey")
    eighths = (k % 8).cast("double") / 8
    amount = F.lit(1e10) * (k % 1000 + 1) + k.cast("double") + eighths
    signed = F.when(k % 3 == 0, -amount).otherwise(amount)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", signed.alias("amount"))
    return rows.select("o_orderkey", round_exact(F.col("amount"), 2).alias("rounded"))
