"""Type-specific comparison of two values, as Column expressions.

Both columns are taken to be non-null: the outcome logic in ``operators.score`` deals with nulls
first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldledger.functions.text import WS_RUN

# Tolerances.
TEXT_THRESHOLD = 85 / 100
MONEY_ABSOLUTE = 0.01
MONEY_RELATIVE = 0.005
NUMBER_ABSOLUTE = 1e-6


def same(p: Column, t: Column) -> Column:
    """1 when equal, else 0. Codes are normalised first, dates and times are ISO text."""
    return (p == t).cast("double")


def number_match(p: Column, t: Column) -> Column:
    return F.abs(p - t) <= NUMBER_ABSOLUTE  # NaN sorts above everything, so it never matches


def money_match(p: Column, t: Column) -> Column:
    off = F.abs(p - t)
    near = F.when(t != 0, off / F.abs(t) <= MONEY_RELATIVE).otherwise(False)
    return (off <= MONEY_ABSOLUTE) | near


def money_score(p: Column, t: Column) -> Column:
    """One minus the error relative to the true amount (or to 1 if that is larger), at least 0."""
    score = F.lit(1.0) - F.abs(p - t) / F.greatest(F.abs(t), F.lit(1.0))
    return F.nanvl(F.greatest(score, F.lit(0.0)), F.lit(0.0))


def text_quick(p: Column, t: Column) -> Column:
    """Text similarity where it needs no edit distance, else null. Inputs are normalised."""

    def words(c: Column) -> Column:
        return F.split(c, WS_RUN)

    def covered(a: Column, b: Column) -> Column:
        return F.size(F.array_except(words(a), words(b))) == 0

    return (
        F.when(p == t, 1.0)
        .when((p == "") | (t == ""), 0.0)
        .when(covered(p, t) | covered(t, p), 1.0)
    )
