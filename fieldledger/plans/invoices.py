"""Invoice truth and predictions derived from the order tables.

An invoice is an order. Its lines are the order's line numbers, each with its shipments added
up: that aggregation combines map-side, so an order with very many shipment rows still reaches
the reducers as one row per line number, and the list built per invoice stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.schemas import INVOICE, Group, Items, struct_type
from fieldledger.sources.storage import partitions

RUNS: tuple[tuple[str, str | None], ...] = (("alpha", "minimal"), ("beta", None))
SHIFT = {"alpha": 0, "beta": 3}
VENDOR = "Northwind Paper Co"
#: An order's key is in one dataset only: its records lie and meet by it.
KEY = ("doc_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(schema: Group, values: dict, raw: bool = False) -> Column:
    """A record of the schema with the given values and nulls elsewhere."""
    out = []
    types = struct_type(schema, raw)
    for name, node in schema.fields.items():
        value = values.get(name)
        if value is None:
            value = F.lit(None)
        elif isinstance(node, Group) and isinstance(value, dict):
            value = build(node, value, raw)
        elif isinstance(node, Items) and callable(value):
            value = value(node.group)
        out.append(value.cast(types[name].dataType).alias(name))
    return F.struct(*out)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number): its shipments added up exactly."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("decimal(15,2)")).cast("double").alias("quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("amount"),
        F.max("l_tax").alias("tax_rate"),
        F.min("l_partkey").alias("partkey"),
    )


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order as one list, dealt by the order's document id."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = order_lines(spark, sf_dir).join(
        part, F.col("partkey") == F.col("p_partkey"), "left"
    )
    columns = ("l_linenumber", "p_name", "partkey", "quantity", "amount", "tax_rate")
    named = lines.select(F.col("l_orderkey").cast("string").alias("list_id"), *columns)
    # One row per line number is left of an order, so lines travel as they are, not in partial lists.
    dealt = named.repartition(partitions(spark), "list_id")
    return dealt.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("lines"))


def order_heads(
    spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, lists: DataFrame | None = None
) -> DataFrame:
    """Orders (the table, or a stream of it) with customer, country and lines.

    The rows lie by ``doc_id``, the key under which records are paired, so that no record built of
    them moves again. The number of partitions is fixed: records are far larger than what was
    shuffled for them, by which adaptive execution would merge partitions. ``lists`` may be a stored
    ``order_lists``.
    """
    if orders is None:
        orders = table(spark, sf_dir, "orders")
    if lists is None:
        lists = order_lists(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    heads = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "o_orderkey",
            F.col("o_orderkey").cast("string").alias("doc_id"),
            F.lower("o_orderstatus").alias("dataset"),
            F.to_date("o_orderdate").alias("order_date"),
            "o_totalprice",
            "c_name",
            "n_name",
        )
    )
    return (
        heads.repartition(partitions(spark), "doc_id")
        .join(lists, F.col("doc_id") == F.col("list_id"), "left")
        .drop("list_id")
    )


def _items(group: Group, raw: bool, bump: Column | None = None, swap: Column | None = None):
    def one(x: Column) -> Column:
        name, quantity = x["p_name"], x["quantity"]
        if swap is not None:
            turned = F.array_join(F.reverse(F.split(name, " ")), " ")
            name = F.when(swap, turned).otherwise(name)
        if bump is not None:
            quantity = F.when(bump, quantity + 1).otherwise(quantity)
        return build(
            group,
            {
                "description": name,
                "sku": x["partkey"].cast("string"),
                "quantity": quantity,
                "unit_price": x["amount"] / x["quantity"],
                "tax_rate": x["tax_rate"],
                "total": x["amount"],
            },
            raw,
        )

    return F.transform(F.coalesce("lines", F.array()), one)


def _base(heads_raw: bool) -> dict:
    date = F.col("order_date")
    return {
        "invoice_number": F.col("o_orderkey").cast("string"),
        "invoice_date": F.date_format(date, "yyyy-MM-dd") if heads_raw else date,
        "vendor": {"name": F.lit(VENDOR)},
        "customer": {"name": F.col("c_name"), "address": {"country": F.col("n_name")}},
        "line_items": lambda g: _items(g, heads_raw),
        "total": F.col("o_totalprice"),
        "currency": F.lit("USD"),
    }


def truth_invoices(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    """dataset, doc_id, truth."""
    return order_heads(spark, sf_dir, lists=lists).select(
        "dataset",
        "doc_id",
        build(INVOICE, _base(True), raw=True).alias("truth"),
    )


def predicted_invoices(
    spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, lists: DataFrame | None = None
) -> DataFrame:
    """Truth disturbed in known ways, one row per run and order that has a prediction."""
    runs = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(e).cast("string").alias("effort"),
                F.lit(SHIFT[m]).alias("shift"),
            )
            for m, e in RUNS
        ]
    )
    heads = order_heads(spark, sf_dir, orders, lists).select("*", F.inline(runs))
    heads = heads.withColumn("r", F.col("o_orderkey") + F.col("shift")).where("r % 29 <> 0")
    r = F.col("r")
    values = _base(False)
    total = F.col("o_totalprice")
    name = F.col("c_name")
    values["total"] = (
        F.when(r % 11 == 0, total * 1.01).when(r % 13 == 0, total * 1.003).otherwise(total)
    )
    values["customer"] = F.when(
        r % 7 != 0,
        build(
            INVOICE.fields["customer"],
            {
                "name": F.when(r % 17 == 0, F.concat(F.upper(name), F.lit(" LTD")))
                .when(r % 31 == 0, F.lit("qqqqqq wwwwww"))
                .otherwise(name),
                "address": {"country": F.col("n_name")},
            },
        ),
    )
    values["shipping"] = F.when(r % 19 == 0, 9.99)

    def items(group: Group) -> Column:
        all_items = _items(group, False, bump=r % 41 == 0, swap=r % 43 == 0)
        shorter = F.slice(all_items, 1, F.greatest(F.size(all_items) - 1, F.lit(0)))
        return F.when(r % 23 == 0, shorter).otherwise(all_items)

    values["line_items"] = items
    failed = r % 37 == 0
    return heads.select(
        "model",
        "effort",
        "dataset",
        "doc_id",
        F.when(~failed, build(INVOICE, values)).alias("data"),
        F.when(failed, "timeout").alias("error"),
        (F.lit(1000.0) + r % 997).alias("latency_ms"),
        (F.lit(100) + r % 50).cast("int").alias("input_tokens"),
        (F.lit(20) + r % 7).cast("int").alias("output_tokens"),
    )
