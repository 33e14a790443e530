"""Messy receipt annotations -> canonical receipts, with rejects kept beside a reason.

Annotations arrive as JSON text of varying shape, so they are parsed once into VARIANT and
picked apart with built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldledger.functions.labels import default_id
from fieldledger.functions.numbers import parse_date, parse_money, round_money
from fieldledger.functions.text import clean_text, let, strip
from fieldledger.operators.stages import compute_once
from fieldledger.schemas import RECEIPT, struct_type

# Currencies and fallback names of the two sources.
FLAT_CURRENCY = "SGD"
MENU_CURRENCY = "KRW"
UNKNOWN_MERCHANT = "Unknown merchant"

RECEIPT_TYPE = struct_type(RECEIPT)
_EMPTY_JSON = ("null", '""', "{}", "[]", "0", "0.0", "false")


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def truthy(v: Column) -> Column:
    """The value itself, or null when it is empty, zero, false or missing."""
    return let(v, lambda x: F.when(~F.to_json(x).isin(*_EMPTY_JSON), x))


def first_truthy(v: Column, *names: str) -> Column:
    return F.coalesce(*[truthy(member(v, n)) for n in names])


def either(v: Column, name: str, otherwise: str) -> Column:
    """Member ``name`` unless it is empty; then ``otherwise``, even a zero."""
    return F.coalesce(truthy(member(v, name)), member(v, otherwise))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, or a number type."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def amount(v: Column) -> Column:
    """Money from a JSON value: numbers are only rounded, strings are parsed."""

    def read(x: Column) -> Column:
        number = F.when(F.schema_of_variant(x) != "STRING", F.try_variant_get(x, "$", "double"))
        return F.coalesce(round_money(number), parse_money(as_text(x)))

    return let(v, read)


def unwrap(v: Column, *names: str) -> Column:
    """First non-empty member among ``names``, else the value itself; text is decoded."""

    def decoded(x: Column) -> Column:
        return F.when(kind(x) == "STRING", F.try_parse_json(as_text(x))).otherwise(x)

    return let(F.coalesce(first_truthy(v, *names), v), decoded)


def as_object(v: Column) -> Column:
    return let(v, lambda x: F.when(kind(x) == "OBJECT", x))


def _receipt(**values: Column) -> Column:
    return F.struct(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RECEIPT_TYPE.fields
        ]
    )


def _result(df: DataFrame, source: str, position: str, id_col: Column) -> DataFrame:
    ok = F.col("reason").isNull()
    return df.select(
        F.col(position).alias("pos"),
        id_col.alias("id"),
        F.lit(source).alias("source"),
        F.when(ok, F.col("receipt")).alias("ground_truth"),
        "reason",
    )


def normalize_flat(
    df: DataFrame, raw: str = "raw", position: str = "pos", source: str = "sroie"
) -> DataFrame:
    """Four-field receipts (company, address, date, total), flat or wrapped.

    pos, id, source, ground_truth, reason; reason is null exactly when the record is usable.
    """
    src = F.col("src")
    parsed = compute_once(df, v=F.try_parse_json(raw))
    opened = compute_once(
        parsed, src=as_object(unwrap(F.col("v"), "parsed_data", "ground_truth"))
    )
    fields = compute_once(
        opened,
        company=clean_text(as_text(first_truthy(src, "company", "merchant"))),
        address=clean_text(as_text(truthy(member(src, "address")))),
        date=parse_date(as_text(member(src, "date"))),
        total=amount(either(src, "total", "amount")),
    )
    reason = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(src.isNull(), "not_an_object")
        .when(F.col("company").isNull(), "missing_company")
        .when(F.col("total").isNull(), "missing_total")
        .when(F.col("total") < 0, "negative_total")
    )
    address_type = RECEIPT_TYPE["merchant_address"].dataType
    address = F.struct(
        *[
            (F.col("address") if n == "line1" else F.lit(None)).cast(T.StringType()).alias(n)
            for n in address_type.names
        ]
    )
    receipt = _receipt(
        merchant=F.col("company"),
        merchant_address=F.when(F.col("address").isNotNull(), address),
        transaction_date=F.col("date"),
        line_items=F.array(),
        total=F.col("total"),
        currency=F.lit(FLAT_CURRENCY),
    )
    out = compute_once(fields, reason=reason).withColumn("receipt", receipt)
    ids = [as_text(truthy(member(F.col("v"), n))) for n in ("id", "image_id")]
    return _result(out, source, position, default_id(source, F.col(position), *ids))


_ENTRY = "struct<nm:variant,cnt:variant,unitprice:variant,price:variant>"


def _menu_items(src: Column) -> Column:
    """Array of raw menu entries, each taken apart at once and null if it is no object; a single entry
    counts as a list of one."""

    def entries(menu: Column) -> Column:
        one = let(F.try_variant_get(menu, "$", _ENTRY), lambda m: F.when(m.isNotNull(), F.array(m)))
        many = F.try_variant_get(menu, "$", f"array<{_ENTRY}>")
        return F.coalesce(many, one, F.array().cast(f"array<{_ENTRY}>"))

    return let(member(src, "menu"), entries)


def _line_item(m: Column) -> Column:
    price = F.coalesce(truthy(m["unitprice"]), m["price"])
    return F.struct(
        clean_text(as_text(truthy(m["nm"]))).alias("description"),
        strip(as_text(m["cnt"])).try_cast("double").alias("quantity"),
        amount(price).alias("unit_price"),
        amount(m["price"]).alias("total"),
    )


def normalize_menu(
    df: DataFrame, raw: str = "raw", position: str = "pos", source: str = "cord"
) -> DataFrame:
    """Receipts with a menu, a subtotal block and a total block.

    Malformed records (also a negative count, or menu entries that are not objects) are set
    aside with a reason instead of ending the load.
    """
    gt, src = F.col("gt"), F.col("src")
    parsed = compute_once(df, v=F.try_parse_json(raw))
    opened = compute_once(
        parsed, gt=as_object(unwrap(F.col("v"), "ground_truth", "gt_parse"))
    )
    opened = compute_once(
        opened, src=as_object(F.coalesce(first_truthy(gt, "gt_parse", "valid_line"), gt))
    )
    sub_total, totals = member(src, "sub_total"), member(src, "total")
    fields = compute_once(
        opened,
        menu=_menu_items(src),
        subtotal=amount(member(sub_total, "subtotal_price")),
        tax=amount(member(sub_total, "tax_price")),
        total=amount(either(totals, "total_price", "cashprice")),
        merchant=clean_text(as_text(first_truthy(src, "merchant", "nm"))),
    )
    items = F.filter(F.transform("menu", _line_item), lambda x: x["description"].isNotNull())
    fields = compute_once(fields, items=items)
    reason = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(src.isNull(), "not_an_object")
        .when(F.exists("menu", lambda m: m.isNull()), "bad_menu_entry")
        .when(F.exists("items", lambda x: x["quantity"] < 0), "negative_quantity")
        .when(F.col("total").isNull(), "missing_total")
        .when(F.col("total") < 0, "negative_total")
    )
    receipt = _receipt(
        merchant=F.coalesce("merchant", F.lit(UNKNOWN_MERCHANT)),
        line_items=F.col("items"),
        subtotal=F.col("subtotal"),
        tax=F.col("tax"),
        total=F.col("total"),
        currency=F.lit(MENU_CURRENCY),
    )
    out = compute_once(fields, reason=reason).withColumn("receipt", receipt)
    ids = as_text(truthy(member(F.col("v"), "id")))
    return _result(out, source, position, default_id(source, F.col(position), ids))


def usable(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason IS NULL").drop("reason")


def rejects(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason IS NOT NULL").select("id", "source", "reason")


def first_usable(normalized: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` usable records in input order; none or 0 means all."""
    good = usable(normalized)
    return good.orderBy("pos").limit(limit) if limit else good
