"""Readable reports from run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.numbers import fixed, percent, round_exact
from fieldledger.operators.score import RUN


def field_table(stats: DataFrame) -> DataFrame:
    """Field statistics with display rounding, without the fields nobody ever filled."""
    return stats.where("support > 0 OR fp > 0").select(
        *RUN,
        F.col("path").alias("field"),
        F.col("ftype").alias("field_type"),
        "tp",
        "fp",
        "fn",
        "tn",
        "support",
        *[round_exact(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")],
        *[F.col(c).alias(f"{c}_exact") for c in ("precision", "recall", "f1")],
    )




def report_order(f1: str = "f1_exact") -> list[Column]:
    return [F.col("support").desc(), F.col(f1).desc(), F.col("field").asc()]


def field_lines(stats: DataFrame) -> DataFrame:
    """run, support, f1_exact, field, line: one markdown row per field."""
    t = field_table(stats)
    line = F.format_string(
        "| `%s` | %s | %d | %s | %s | %s |",
        "field",
        "field_type",
        "support",
        *[fixed(F.col(c), 3) for c in ("precision_exact", "recall_exact", "f1_exact")],
    )
    return t.select(*RUN, "support", "f1_exact", "field", line.alias("line"))


# The rows of the headline table.
_HEADLINE = [
    ("Documents evaluated", lambda: F.col("n_docs").cast("string")),
    ("Extractor errors   ", lambda: F.col("errors").cast("string")),
    ("**Micro F1**       ", lambda: fixed(F.col("micro_f1"), 4, "**", "**")),
    ("**Macro F1**       ", lambda: fixed(F.col("macro_f1"), 4, "**", "**")),
    ("Doc exact-match rate", lambda: percent(F.col("doc_exact_match"), 2)),
    ("Mean latency       ", lambda: fixed(F.col("mean_latency_ms"), 0, after=" ms")),
    ("Mean cost / doc    ", lambda: fixed(F.col("mean_cost_usd"), 6, "$")),
    ("Total cost         ", lambda: fixed(F.col("total_cost_usd"), 4, "$")),
]


def headline_lines(summary: DataFrame) -> DataFrame:
    """run, pos, line: the headline table of each run."""
    lines = [
        F.concat(F.lit(f"| {name} | "), value(), F.lit(" |")) for name, value in _HEADLINE
    ]
    title = F.concat(
        F.lit("# Evaluation Report — `"), F.col("doc_type"), F.lit("` on `"), F.col("label"), F.lit("`")
    )
    top = [title, F.lit(""), F.lit("## Headline"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|")]
    return summary.select(*RUN, F.posexplode(F.array(*top, *lines)).alias("pos", "line"))


def error_lines(docs: DataFrame) -> DataFrame:
    return docs.where("error IS NOT NULL").select(
        *RUN, "doc_id", F.format_string("- `%s`: %s", "doc_id", "error").alias("line")
    )
