"""Document schemas, declared once and turned into whatever a plan needs.

A schema is a small tree of ``Leaf`` / ``Group`` / ``Items`` nodes. From that tree the
library derives Spark types, comparator types per field path, and validation rules, all on
the driver and before any data is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """One scalar field. ``clean`` names the coercion applied to a prediction."""

    kind: str  # text | float | int | date | time
    required: bool = False
    clean: str = "strip"  # strip | upper | currency | cik | money | none
    default: str | None = None  # used when the key is absent
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Group:
    """A nested record."""

    fields: dict[str, "Leaf | Group | Items"] = field(hash=False)
    required: bool = False


@dataclass(frozen=True)
class Items:
    """A list of nested records."""

    group: Group
    limit: int | None = None


def _text(**kw) -> Leaf:
    return Leaf("text", **kw)


def _money(**kw) -> Leaf:
    return Leaf("float", clean="money", **kw)


def _float(**kw) -> Leaf:
    return Leaf("float", clean="none", **kw)


_DATE = Leaf("date")
_TIME = Leaf("time")

# --- fixed values: field names, order, required flags and ranges of the document types ----------

_ADDRESS = {
    "line1": _text(),
    "line2": _text(),
    "city": _text(),
    "region": _text(),
    "postal_code": _text(),
    "country": _text(),
}

_PARTY = {
    "name": _text(required=True),
    "address": Group(_ADDRESS),
    "tax_id": _text(),
    "email": _text(),
    "phone": _text(),
}

INVOICE = Group(
    {
        "invoice_number": _text(required=True),
        "purchase_order_number": _text(),
        "invoice_date": _DATE,
        "due_date": _DATE,
        "service_period_start": _DATE,
        "service_period_end": _DATE,
        "vendor": Group(_PARTY, required=True),
        "customer": Group(_PARTY),
        "line_items": Items(
            Group(
                {
                    "description": _text(required=True),
                    "sku": _text(),
                    "quantity": _float(low=0),
                    "unit_price": _money(),
                    "tax_rate": _float(low=0, high=1),
                    "total": _money(),
                }
            )
        ),
        "subtotal": _money(),
        "discount": _money(),
        "tax": _money(),
        "shipping": _money(),
        "total": _money(required=True, low=0),
        "currency": _text(required=True, clean="currency"),
        "payment_terms": _text(),
        "payment_instructions": _text(),
    }
)

RECEIPT = Group(
    {
        "merchant": _text(required=True),
        "merchant_address": Group(_ADDRESS),
        "merchant_phone": _text(),
        "transaction_date": _DATE,
        "transaction_time": _TIME,
        "receipt_number": _text(),
        "line_items": Items(
            Group(
                {
                    "description": _text(required=True),
                    "quantity": _float(low=0),
                    "unit_price": _money(),
                    "total": _money(),
                }
            )
        ),
        "subtotal": _money(),
        "tax": _money(),
        "tip": _money(),
        "total": _money(required=True, low=0),
        "currency": _text(required=True, clean="currency"),
        "payment_method": _text(),
    }
)

FILING = Group(
    {
        "cover": Group(
            {
                "company_name": _text(required=True),
                "cik": _text(clean="cik"),
                "ticker": _text(clean="upper"),
                "exchange": _text(),
                "form_type": _text(required=True, default="10-K"),
                "fiscal_year_end": _DATE,
                "filing_date": _DATE,
                "state_of_incorporation": _text(clean="upper"),
                "address": Group(_ADDRESS),
            },
            required=True,
        ),
        "financials": Group(
            {
                "currency": _text(required=True, clean="filing_currency", default="USD"),
                "fiscal_year": Leaf("int", clean="none", low=1900, high=2100),
                "revenue": _money(),
                "cost_of_revenue": _money(),
                "gross_profit": _money(),
                "operating_income": _money(),
                "net_income": _money(),
                "eps_basic": _float(),
                "eps_diluted": _float(),
                "cash_and_equivalents": _money(),
                "total_debt": _money(),
                "total_assets": _money(),
                "total_equity": _money(),
                "operating_cash_flow": _money(),
                "free_cash_flow": _money(),
            },
            required=True,
        ),
        "top_risk_factors": Items(
            Group({"theme": _text(required=True), "summary": _text(required=True)}), limit=5
        ),
    }
)

CONFIDENCES = Items(
    Group(
        {
            "field": _text(required=True),
            "score": _float(required=True, low=0, high=1),
            "reasoning": _text(),
        }
    )
)

WARNINGS = Items(
    Group(
        {
            "field": _text(),
            "message": _text(required=True),
            "severity": _text(
                required=True, default="info", choices=("info", "warning", "error")
            ),
        }
    )
)

# Float leaves with these names are compared as money, other floats as plain numbers.
MONEY_NAMES = frozenset(
    ("total", "subtotal", "tax", "tip", "discount", "shipping", "unit_price", "price", "amount")
)
# String leaves with these names are compared exactly, other strings fuzzily.
EXACT_NAMES = frozenset(
    (
        "currency", "sku", "invoice_number", "purchase_order_number", "receipt_number", "tax_id",
        "postal_code", "country", "phone", "merchant_phone", "payment_method",
    )
)

# --- end of fixed values ------------------------------------------------------------------------

DOC_TYPES: dict[str, Group] = {"filing": FILING, "invoice": INVOICE, "receipt": RECEIPT}


def doc_type_names() -> list[str]:
    return sorted(DOC_TYPES)


def get_schema(doc_type: str) -> Group:
    """Schema by name; case and surrounding blanks do not matter, unknown names raise."""
    try:
        return DOC_TYPES[doc_type.strip().lower()]
    except KeyError:
        raise KeyError(
            f"unknown document type {doc_type!r}; known: {', '.join(doc_type_names())}"
        ) from None


def envelope(doc_type: str) -> Group:
    """What an extractor emits: the record itself plus confidences and warnings."""
    record = get_schema(doc_type)
    return Group(
        {
            "data": Group(record.fields, required=True),
            "field_confidences": CONFIDENCES,
            "warnings": WARNINGS,
        }
    )


def field_type(name: str, leaf: Leaf, overrides: dict[str, str] | None = None) -> str:
    """Comparator of a leaf: text, exact, money, number, date or time."""
    if overrides and name in overrides:
        return overrides[name]
    if leaf.kind in ("date", "time"):
        return leaf.kind
    if leaf.kind == "int":
        return "number"
    if leaf.kind == "float":
        return "money" if name in MONEY_NAMES else "number"
    if leaf.kind == "text":
        return "exact" if name in EXACT_NAMES else "text"
    return "exact"


def field_types(
    schema: Group, overrides: dict[str, str] | None = None, prefix: str = ""
) -> Iterator[tuple[str, str]]:
    """(path pattern, comparator) for every leaf; list positions are written ``[i]``."""
    for name, node in schema.fields.items():
        path = prefix + name
        if isinstance(node, Group):
            yield from field_types(node, overrides, path + ".")
        elif isinstance(node, Items):
            yield path + "[]", "number"
            yield from field_types(node.group, overrides, path + "[i].")
        else:
            yield path, field_type(name, node, overrides)


_LEAF_TYPES = {
    "text": T.StringType(),
    "float": T.DoubleType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "time": T.StringType(),
}


def struct_type(schema: Group, raw: bool = False) -> T.StructType:
    """Spark type of a record. ``raw`` keeps dates as text, the way ground truth is compared."""
    fields = []
    for name, node in schema.fields.items():
        if isinstance(node, Group):
            dtype: T.DataType = struct_type(node, raw)
        elif isinstance(node, Items):
            dtype = T.ArrayType(struct_type(node.group, raw))
        elif raw and node.kind == "date":
            dtype = T.StringType()
        else:
            dtype = _LEAF_TYPES[node.kind]
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def truth_row_type(doc_type: str) -> T.StructType:
    """One ground-truth line: id, source, record, and the document it came from."""
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("ground_truth", struct_type(get_schema(doc_type), raw=True)),
            T.StructField("text", T.StringType()),
            T.StructField("file_path", T.StringType()),
        ]
    )
