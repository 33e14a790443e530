"""Chat-format training rows and an exact, reproducible train/validation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldledger.functions.text import ascii_json
from fieldledger.operators.sections import chat, document_message, prompt_for

# Fixed values.
MIN_TRAIN_ROWS = 10
DEFAULT_FRACTION = 0.2
DEFAULT_SEED = 42

_EMPTY_TRUTH = ("null", "{}", "")


def envelope_json(truth_json: Column) -> Column:
    """Ground truth wrapped as a confident, warning-free extraction, as compact ASCII JSON."""
    return ascii_json(
        F.concat(F.lit('{"data":'), truth_json, F.lit(',"field_confidences":[],"warnings":[]}'))
    )


def text_problem(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "no_text")


def truth_problem(truth_json: Column) -> Column:
    return F.when(F.coalesce(truth_json, F.lit("")).isin(*_EMPTY_TRUTH), "empty_ground_truth")


def row_problem(text: Column, truth_json: Column) -> Column:
    return F.coalesce(text_problem(text), truth_problem(truth_json))


def chat_rows(
    df: DataFrame,
    doc_type: str,
    prompts: dict[str, str],
    text: str = "text",
    truth: str = "ground_truth",
) -> DataFrame:
    """Add ``messages`` and ``problem``; exactly one of the two is null."""
    body = F.col(truth)
    if df.schema[truth].dataType.typeName() != "string":
        body = F.to_json(body, {"ignoreNullFields": "false"})
    problem = row_problem(F.col(text), body)
    messages = chat(
        prompt_for(F.lit(doc_type), prompts),
        document_message(F.col(text)),
        ("assistant", envelope_json(body)),
    )
    return df.select(
        "*", F.when(problem.isNull(), messages).alias("messages"), problem.alias("problem")
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NULL").drop("problem")


def skipped(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.where("problem IS NOT NULL").select(*ids, "problem")


def split_sizes(n: Column, fraction: float) -> Column:
    """Number of validation rows out of ``n``: at least one, unless the fraction is 0."""
    if fraction <= 0:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0)).cast("long")


def _cut(counts: DataFrame, cell: str, wanted: Column) -> Column:
    """The cell in which the ``wanted``-th row falls, and how many rows lie before it.

    ``counts`` (cell, n) has at most 2^bits rows, so a window over all of it is small.
    """
    everything = Window.orderBy(cell)
    up_to = F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(
        everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ranked = counts.withColumn("upto", up_to).withColumn("total", total)
    ranked = ranked.withColumn("want", wanted)
    hit = (F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))
    return (
        ranked.where(hit)
        .select(
            F.struct(
                F.col(cell).alias("cell"),
                (F.col("want") - (F.col("upto") - F.col("n"))).alias("want"),
            )
        )
        .scalar()
    )


def split(
    df: DataFrame,
    ids: Sequence[str],
    fraction: float = DEFAULT_FRACTION,
    seed: int = DEFAULT_SEED,
    bits: int = 12,
) -> DataFrame:
    """Add ``split`` (``val`` or ``train``) with an exact number of validation rows.

    Rows are ordered by a seeded hash of ``ids``, which must identify a row; the first n_val of
    that order validate. The cut is found in three narrow passes over the ids: count per hash
    range (2^bits groups, combined map-side), count per finer range inside the range that holds
    the cut, then rank the rows of that one cell (about n / 4^bits of them). Marking the rows
    is a comparison with three scalars, so the data itself is never shuffled or ranked.
    """
    if fraction <= 0:
        return df.withColumn("split", F.lit("train"))

    def keyed(rows: DataFrame) -> DataFrame:
        h = F.xxhash64(F.lit(seed), *ids)
        return rows.select(
            "*",
            h.alias("_h"),
            F.shiftrightunsigned(h, 64 - bits).alias("_top"),
            F.shiftrightunsigned(h, 64 - 2 * bits).bitwiseAND(2**bits - 1).alias("_fine"),
        )

    names = keyed(df.select(*ids))
    place = F.struct("_h", *ids)
    n_val = split_sizes(F.col("total"), fraction)
    top = _cut(names.groupBy("_top").agg(F.count("*").alias("n")), "_top", n_val)
    in_top = names.where(F.col("_top") == top["cell"])
    fine = _cut(in_top.groupBy("_fine").agg(F.count("*").alias("n")), "_fine", top["want"])
    in_cell = in_top.where(F.col("_fine") == fine["cell"])
    edge = (
        in_cell.withColumn("_rank", F.row_number().over(Window.orderBy(place)))
        .where(F.col("_rank") == fine["want"])
        .select(place.alias("place"))
        .scalar()
    )
    same_top = F.col("_top") == top["cell"]
    held_out = (
        (F.col("_top") < top["cell"])
        | (same_top & (F.col("_fine") < fine["cell"]))
        | (same_top & (F.col("_fine") == fine["cell"]) & (place <= edge))
    )
    return (
        keyed(df)
        .withColumn("split", F.when(held_out, "val").otherwise("train"))
        .drop("_h", "_top", "_fine")
    )


def enough_rows(rows: DataFrame) -> DataFrame:
    """Rows per split, and a warning where the training part is too small to be accepted."""
    counts = rows.groupBy("split").agg(F.count("*").alias("n_rows"))
    few = (F.col("split") == "train") & (F.col("n_rows") < MIN_TRAIN_ROWS)
    return counts.withColumn(
        "warning", F.when(few, F.lit(f"fewer than {MIN_TRAIN_ROWS} training rows"))
    )
