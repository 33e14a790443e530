"""Identifiers, labels and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldledger.functions.text import blank_to_null, strip

# Default token prices in USD per thousand tokens, one pair for all models.
PRICE_PER_1K_INPUT = 0.00005
PRICE_PER_1K_OUTPUT = 0.0004


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in / F.lit(1000.0)) * price_in + (tokens_out / F.lit(1000.0)) * price_out


def model_of(spec: Column) -> Column:
    """``name[:effort]`` -> name."""
    return strip(F.element_at(F.split(spec, ":", 2), 1))


def effort_of(spec: Column) -> Column:
    """``name[:effort]`` -> effort, null when absent or blank."""
    return blank_to_null(strip(F.get(F.split(spec, ":", 2), F.lit(1))))


def combo_label(model: Column, effort: Column) -> Column:
    """``name@effort``, or just the name."""
    return F.concat(model, F.coalesce(F.concat(F.lit("@"), effort), F.lit("")))


def run_label(model: Column, effort: Column) -> Column:
    """``name_re-effort``, or just the name; no name means ``default``."""
    return F.concat(
        F.coalesce(model, F.lit("default")),
        F.coalesce(F.concat(F.lit("_re-"), effort), F.lit("")),
    )


def report_tag(doc_type: Column, label: Column) -> Column:
    return F.concat(doc_type, F.lit("_"), F.translate(label, "/", "_"))


def accession_digits(accession: Column) -> Column:
    return F.translate(accession, "-", "")


def archive_url(cik: Column, accession: Column, primary_doc: Column) -> Column:
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"),
        cik.cast("bigint").cast("string"),
        F.lit("/"),
        accession_digits(accession),
        F.lit("/"),
        primary_doc,
    )


def filing_id(ticker: Column, period_end: Column) -> Column:
    return F.concat(F.lit("filing_"), ticker, F.lit("_"), period_end)


def filing_stem(ticker: Column, period_end: Column) -> Column:
    return F.concat(F.upper(ticker), F.lit("_"), period_end, F.lit("_10k"))


def default_id(prefix: str, position: Column, *candidates: Column) -> Column:
    """First non-empty candidate, else ``prefix_00017`` from the row's position."""
    numbered = F.format_string(prefix + "_%05d", position)
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in candidates], numbered)
