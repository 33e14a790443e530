"""Keeping a computed column computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps refer to by value, never by expression.

    A filter on an ordinary computed column is pushed below the projection that computes it,
    with every alias replaced by its expression; after a few dependent steps one predicate can
    repeat the costly first step (parsing a JSON text, say) hundreds of times. Columns that come
    out of a one-row generator cannot be substituted that way.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    # Built in a projection, which is compiled; a generator's own input may not be.
    return df.select(*kept, F.array(row).alias("_row")).select(*kept, F.inline_outer("_row"))
