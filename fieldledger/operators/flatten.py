"""Nested record -> field paths, generated from the schema as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.numbers import fixed_4
from fieldledger.schemas import Group, Items, Leaf, field_type

LEAF_TYPE = "array<struct<path:string,ftype:string,v_str:string,v_num:double>>"


def join_path(prefix: Column | str, name: str) -> Column | str:
    if isinstance(prefix, str):
        return prefix + name
    return F.concat(prefix, F.lit(name))


def as_column(path: Column | str) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def leaf_text(value: Column, leaf: Leaf, raw: bool) -> Column:
    """Text under which a non-numeric leaf is compared and shown."""
    if leaf.kind == "date" and not raw:
        return F.date_format(value, "yyyy-MM-dd")
    return value.cast("string")


def is_numeric(leaf: Leaf) -> bool:
    return leaf.kind in ("float", "int")


def list_length(items: Column) -> Column:
    """Length of a list, 0 when it is null."""
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def by_position(length: Column, make: Callable[[Column], Column], empty_type: str) -> Column:
    """``flatten([make(0), …, make(length-1)])``, empty when the length is 0."""
    empty = F.from_json(F.lit("[]"), empty_type)
    positions = F.sequence(F.lit(0), length - 1)
    return F.when(length > 0, F.flatten(F.transform(positions, make))).otherwise(empty)


def flatten_record(
    record: Column,
    schema: Group,
    raw: bool = False,
    overrides: dict[str, str] | None = None,
    prefix: Column | str = "",
) -> Column:
    """Array of (path, ftype, v_str, v_num) for one record.

    A null nested record gives no paths, a present one gives all of its leaves. A list gives
    ``name[]`` with its length and then the leaves of each element under ``name[i].``.
    """
    leaves, parts = [], []
    for name, node in schema.fields.items():
        path = join_path(prefix, name)
        value = record[name]
        if isinstance(node, Group):
            parts.append(flatten_record(value, node, raw, overrides, join_path(path, ".")))
        elif isinstance(node, Items):
            leaves.append(_leaf(join_path(path, "[]"), "number", None, list_length(value)))

            def element(i: Column) -> Column:
                where = F.concat(as_column(path), F.lit("["), i.cast("string"), F.lit("]."))
                return flatten_record(F.get(value, i), node.group, raw, overrides, where)

            parts.append(by_position(list_length(value), element, LEAF_TYPE))
        else:
            ftype = field_type(name, node, overrides)
            if is_numeric(node):
                leaves.append(_leaf(path, ftype, None, value))
            else:
                leaves.append(_leaf(path, ftype, leaf_text(value, node, raw), None))
    everything = F.concat(F.array(*leaves), *parts) if parts else F.array(*leaves)
    return F.when(record.isNotNull(), everything).otherwise(F.from_json(F.lit("[]"), LEAF_TYPE))


def _leaf(path: Column | str, ftype: str, text: Column | None, num: Column | None) -> Column:
    return F.struct(
        as_column(path).alias("path"),
        F.lit(ftype).alias("ftype"),
        (F.lit(None).cast("string") if text is None else text).alias("v_str"),
        (F.lit(None).cast("double") if num is None else num.cast("double")).alias("v_num"),
    )


def flatten_rows(
    df: DataFrame,
    record: str,
    schema: Group,
    raw: bool = False,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """Long form: the other columns plus path, ftype, v_str, v_num and the display text."""
    others = [c for c in df.columns if c != record]
    fields = flatten_record(F.col(record), schema, raw, overrides)
    return df.select(*others, F.inline(fields)).withColumn(
        "shown", F.coalesce(F.col("v_str"), fixed_4(F.col("v_num")), F.lit(""))
    )
