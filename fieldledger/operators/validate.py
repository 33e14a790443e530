"""Strict validation of raw extractor output.

The JSON text is parsed once into VARIANT and taken apart by casts to the schema's shape. Every leaf of
the record is then a few expressions over columns, in steps: its type in the JSON, its typed value, its
problem. The elements of lists take the same steps in array functions, beside the record's: each element
sees its own leaves only, and no row is moved. A record with any problem is a reject, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.numbers import round_exact
from fieldledger.functions.text import WHITESPACE, let, snippet
from fieldledger.operators.flatten import list_length
from fieldledger.operators.stages import compute_once
from fieldledger.schemas import Group, Items, Leaf, envelope, struct_type

# Layouts of dates and times inside JSON, and the limit on the kept source text.
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ]00:00(?::00(?:\.0+)?)?)?$"
ISO_TIME = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,6})?)?$"

# Expressions are written as SQL text: a schema has hundreds of them, and each call that builds a
# Column object costs the driver a round trip to the JVM.
_BLANKS = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)


def _strip(x: str) -> str:
    return f"btrim({x}, '{_BLANKS}')"


def _upper(x: str) -> str:
    return f"nullif(upper({_strip(x)}), '')"


_CLEAN: dict[str, Callable[[str], str]] = {
    "strip": _strip,
    "upper": _upper,
    "currency": _upper,
    "filing_currency": lambda x: f"coalesce({_upper(x)}, 'USD')",
}


def _case(*cases: tuple[str, str], otherwise: str = "NULL") -> str:
    if not cases:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in cases) + f" ELSE {otherwise} END"


def _value(text: str, kind: str, leaf: Leaf) -> str:
    """Value of a leaf after coercion; null when absent, null or of the wrong type. Money is not
    rounded yet.

    ``kind`` is the type that the JSON value has, ``text`` the value as text.
    """
    only_text = f"if({kind} = 'STRING', {text}, NULL)"
    if leaf.kind == "text":
        if leaf.clean == "cik":
            s = _strip(text)
            return f"if(rlike({s}, '^[0-9]{{1,9}}$'), lpad({s}, 10, '0'), {s})"
        return _CLEAN[leaf.clean](only_text)
    if leaf.kind in ("float", "int"):
        number = _case(
            (f"{kind} = 'BOOLEAN'", f"CAST({text} = 'true' AS DOUBLE)"),
            (f"startswith({kind}, 'OBJECT') OR startswith({kind}, 'ARRAY')", "NULL"),
            otherwise=f"try_cast({_strip(text)} AS DOUBLE)",
        )
        return f"if({number} = floor({number}), try_cast({number} AS INT), NULL)" if leaf.kind == "int" else number
    s = _strip(only_text)
    if leaf.kind == "date":
        return f"if(rlike({s}, r'{ISO_DATE}'), try_to_date(substring({s}, 1, 10), 'yyyy-MM-dd'), NULL)"
    return f"if(rlike({s}, r'{ISO_TIME}'), if(length({s}) = 5, concat({s}, ':00'), {s}), NULL)"


def _leaf_problem(value: str, kind: str, path: str, leaf: Leaf) -> str:
    """The first problem of a leaf, or null; ``value`` has its default already."""
    lenient = leaf.clean in ("upper", "currency", "filing_currency") and not leaf.required
    cases = []
    if leaf.required and leaf.default is None:
        cases.append((f"{kind} IS NULL", f"'missing:{path}'"))
    if leaf.required:
        cases.append((f"{kind} = 'VOID' AND {value} IS NULL", f"'null:{path}'"))
    if not lenient:
        cases.append((f"{kind} <> 'VOID' AND {value} IS NULL", f"'type:{path}'"))
    if leaf.low is not None:
        cases.append((f"{value} < {leaf.low}", f"'range:{path}'"))
    if leaf.high is not None:
        cases.append((f"{value} > {leaf.high}", f"'range:{path}'"))
    if leaf.choices:
        cases.append((f"{value} NOT IN ({', '.join(map(repr, leaf.choices))})", f"'choice:{path}'"))
    return _case(*cases)


@dataclass
class _View:
    """The flat view of an object: the envelope, whose parts are columns, or an element of a list, whose
    parts are fields of ``e``. Nodes are numbered; ``at`` is a node's place in the object, ``path`` its
    name in problems, ``inside`` the number of its group."""

    group: Group
    path: str = ""
    element: bool = False
    leaves: list[tuple[str, str, int, Leaf]] = field(default_factory=list)
    groups: list[tuple[str, str, int | None, Group]] = field(default_factory=list)
    lists: list[tuple[str, str, int, Items]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._add(self.group, "$", self.path, None)

    def _add(self, group: Group, at: str, path: str, inside: int | None) -> None:
        own = len(self.groups)
        self.groups.append((at, path, inside, group))
        for name, node in group.fields.items():
            place = (f"{at}.{name}", f"{path}.{name}" if path else name, own)
            if isinstance(node, Leaf):
                self.leaves.append((*place, node))
            elif isinstance(node, Items):
                self.lists.append((*place, node))
            else:
                self._add(node, place[0], place[1], own)

    def named(self, part: str) -> str:
        return f"e.{part}" if self.element else f"_{part}"

    def made(self, parts: dict[str, str]) -> list[str]:
        """Parts of the next step: columns, or the fields of one struct."""
        if self.element:
            return [f"named_struct({', '.join(f"'{name}', {x}" for name, x in parts.items())})"]
        return [f"{x} AS _{name}" for name, x in parts.items()]

    def kept(self, *parts: str) -> dict[str, str]:
        return {part: self.named(part) for part in parts}

    def numbered(self, part: str, nodes: list) -> list[str]:
        return [f"{part}{k}" for k in range(len(nodes))]

    @property
    def money(self) -> list[str]:
        return [f"x{k}" for k, (*_, leaf) in enumerate(self.leaves) if leaf.clean == "money"]


def _ddl(group: Group, leaf: str) -> str:
    """Type of a group with all leaves as ``leaf``, without its lists."""
    inside = [
        f"`{name}`: {leaf if isinstance(node, Leaf) else _ddl(node, leaf)}"
        for name, node in group.fields.items()
        if not isinstance(node, Items)
    ]
    return f"struct<{', '.join(inside)}>"


def _opened(view: _View, v: str) -> dict[str, str]:
    """The object taken apart: its leaves as they are and as text, the keys of its groups, its lists."""
    parts = {"v": v}
    for part, leaf in (("raw", "variant"), ("text", "string")):
        parts[part] = f"try_variant_get({v}, '$', '{_ddl(view.group, leaf)}')"
    for k, (at, *_) in enumerate(view.groups):
        # Values stay variants: a failing cast to another type costs an exception each.
        parts[f"keys{k}"] = f"map_keys(try_variant_get({v}, '{at}', 'map<string,variant>'))"
    for k, (at, *_) in enumerate(view.lists):
        parts[f"list{k}"] = f"try_variant_get({v}, '{at}', 'array<variant>')"
    return parts


def _kinds(view: _View) -> dict[str, str]:
    """The types that the leaves have; of a group or list only where it is none."""
    parts = view.kept("text", *view.numbered("keys", view.groups))
    v, raw = view.named("v"), view.named("raw")
    for k, (at, *_) in enumerate(view.leaves):
        parts[f"kind{k}"] = f"schema_of_variant({raw}{at[1:]})"
    for part, node, nodes in (("keys", "other", view.groups), ("list", "otherlist", view.lists)):
        for k, (at, *_) in enumerate(nodes):
            found = f"schema_of_variant(try_variant_get({v}, '{at}', 'variant'))"
            parts[f"{node}{k}"] = f"if({view.named(part)}{k} IS NULL, {found}, NULL)"
    return parts


def _values(view: _View) -> dict[str, str]:
    """The typed leaves, money not rounded yet."""
    parts = view.kept(
        *view.numbered("keys", view.groups),
        *view.numbered("other", view.groups),
        *view.numbered("otherlist", view.lists),
        *view.numbered("kind", view.leaves),
    )
    for k, (at, *_, leaf) in enumerate(view.leaves):
        kind = view.named(f"kind{k}")
        value = _value(view.named("text") + at[1:], kind, leaf)
        parts[f"x{k}"] = value if leaf.default is None else f"if({kind} IS NULL, '{leaf.default}', {value})"
    return parts


def _exact_money(money: list[Column]) -> Column:
    """The amounts rounded to two places by their exact binary value, or null where all of them are so
    already: those that print with at most two decimals."""
    done = F.lit(True)
    for c in money:
        done = done & (c.isNull() | (F.round(c, 2) == c) | (F.abs(c) >= 4503599627370496.0))
    return F.when(~done, F.transform(F.array(*money), lambda x: round_exact(x, 2)))


def _problems(view: _View) -> str:
    """All problems of an object, an array."""
    found, extras = [], []
    for k, (_, path, inside, group) in enumerate(view.groups):
        keys, other = view.named(f"keys{k}"), view.named(f"other{k}")
        known = ", ".join(f"'{name}'" for name in group.fields)
        label = f"extra:{path}." if path else "extra:"
        extras.append(f"transform(array_except({keys}, array({known})), k -> concat('{label}', k))")
        if inside is None:
            continue
        cases = [(f"{keys} IS NOT NULL", "NULL")]
        if group.required:
            cases += [(f"{other} IS NULL", f"'missing:{path}'"), (f"{other} = 'VOID'", f"'null:{path}'")]
        cases.append((f"{other} <> 'VOID'", f"'type:{path}'"))
        found.append(f"if({view.named(f'keys{inside}')} IS NOT NULL, {_case(*cases)}, NULL)")
    for k, (_, path, inside, leaf) in enumerate(view.leaves):
        problem = _leaf_problem(view.named(f"x{k}"), view.named(f"kind{k}"), path, leaf)
        found.append(f"if({view.named(f'keys{inside}')} IS NOT NULL, {problem}, NULL)")
    for k, (_, path, inside, items) in enumerate(view.lists):
        other = view.named(f"otherlist{k}")
        cases = [(f"{other} = 'VOID'", f"'null:{path}'"), (f"{other} IS NOT NULL", f"'type:{path}'")]
        if items.limit is not None:
            cases.append((f"size({view.named(f'e{k}')}) > {items.limit}", f"'range:{path}'"))
        found.append(f"if({view.named(f'keys{inside}')} IS NOT NULL, {_case(*cases)}, NULL)")
    empty = "CAST(array() AS array<string>)"
    extra = ", ".join(f"coalesce({x}, {empty})" for x in extras)
    return f"concat(filter(array({', '.join(found)}), x -> x IS NOT NULL), {extra})"


def _record(view: _View, group: Group, at: str = "$") -> str:
    """The typed record of a group, null unless the value is an object."""
    fields = []
    for name, node in group.fields.items():
        place = f"{at}.{name}"
        if isinstance(node, Leaf):
            x = view.named(f"x{next(k for k, leaf in enumerate(view.leaves) if leaf[0] == place)}")
        elif isinstance(node, Items):
            x = f"_items{next(k for k, items in enumerate(view.lists) if items[0] == place)}"
        else:
            x = _record(view, node, place)
        fields.append(f"'{name}', {x}")
    own = next(k for k, found in enumerate(view.groups) if found[0] == at)
    return f"if({view.named(f'keys{own}')} IS NOT NULL, named_struct({', '.join(fields)}), NULL)"


def validate_envelopes(df: DataFrame, doc_type: str, raw: str = "raw") -> DataFrame:
    """Add ``data``, ``field_confidences``, ``warnings`` and ``reasons``.

    ``reasons`` is empty exactly when the envelope is acceptable; the other three are null
    otherwise. Rows that are equal stay rows of their own. Nothing is moved: an envelope is one row.
    """
    schema = envelope(doc_type)
    head = _View(schema)
    lists = [_View(items.group, f"{path}[]", True) for _, path, _, items in head.lists]
    if any(view.lists for view in lists):
        raise ValueError("a list inside a list is not supported")

    rows = df.select(*df.columns, F.try_parse_json(raw).alias("_root"))
    rows = rows.selectExpr(*df.columns, *head.made(_opened(head, "_root")))
    # Each list is opened beside the envelope's next step.
    below = [f"transform(_list{k}, v -> {view.made(_opened(view, 'v'))[0]}) AS _e{k}" for k, view in enumerate(lists)]
    rows = rows.selectExpr(*df.columns, "_v IS NULL AS _broken", *head.made(_kinds(head)), *below)
    rows = rows.selectExpr(
        *df.columns,
        "_broken",
        *head.made(_values(head)),
        *(f"transform(_e{k}, e -> {view.made(_kinds(view))[0]}) AS _e{k}" for k, view in enumerate(lists)),
    )
    own = [c for c in rows.columns if c not in {f"_e{k}" for k in range(len(lists))}]
    rows = rows.select(
        *own,
        _exact_money([F.col(f"_{c}") for c in head.money]).alias("_exact"),
        *(F.expr(f"transform(_e{k}, e -> {view.made(_values(view))[0]}) AS _e{k}") for k, view in enumerate(lists)),
    )
    money = {f"_{c}": f"if(_exact IS NULL, _{c}, _exact[{i}]) AS _{c}" for i, c in enumerate(head.money)}
    rounded = []
    for k, view in enumerate(lists):
        x = F.col(f"_e{k}")
        if view.money:
            x = F.transform(x, lambda e: _with_exact(e, view.money))
        rounded.append(x.alias(f"_e{k}"))
    rows = rows.select(*(F.expr(money[c]) if c in money else c for c in own), *rounded)
    found = [_problems(head)]
    for k, view in enumerate(lists):
        one = f"if(e.keys0 IS NULL, array('type:{view.path}'), {_problems(view)})"
        found.append(f"coalesce(flatten(transform(_e{k}, e -> {one})), CAST(array() AS array<string>))")
    reasons = _case(
        ("_broken", "array('invalid_json')"),
        ("_keys0 IS NULL", "array('type:envelope')"),
        otherwise=f"array_sort(array_distinct(concat({', '.join(found)})))",
    )
    rows = compute_once(rows, reasons=F.expr(reasons))
    # A list that is absent is an empty one.
    items = [f"coalesce(transform(_e{k}, e -> {_record(view, view.group)}), array()) AS _items{k}" for k, view in enumerate(lists)]
    rows = rows.selectExpr(*own, "reasons", *items)
    made = []
    for name, node in schema.fields.items():
        if isinstance(node, Items):
            x = f"_items{next(k for k, found in enumerate(head.lists) if found[0] == f'$.{name}')}"
        else:
            x = _record(head, node, f"$.{name}")
        made.append(f"if(size(reasons) = 0, {x}, NULL) AS {name}")
    return rows.selectExpr(*df.columns, *made, "reasons")


def _with_exact(e: Column, money: list[str]) -> Column:
    """An element with its money rounded."""

    def replaced(exact: Column) -> Column:
        out = e
        for i, c in enumerate(money):
            out = out.withField(c, F.get(exact, F.lit(i)))
        return F.when(exact.isNull(), e).otherwise(out)

    return let(_exact_money([e[c] for c in money]), replaced)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0).drop("data", "field_confidences", "warnings")


def overall_confidence(confidences: Column) -> Column:
    """Mean score rounded to three places; no scores means 0."""
    total = F.aggregate(confidences, F.lit(0.0), lambda acc, x: acc + x["score"])
    n = list_length(confidences)
    return F.when(n > 0, round_exact(total / n, 3)).otherwise(0.0)


def extraction_results(
    accepted_rows: DataFrame, doc_type: str, text: str = "text", snippet_chars: int | None = None
) -> DataFrame:
    """Accepted envelopes wrapped with what is computed on our side."""
    return accepted_rows.select(
        "*",
        F.lit(doc_type).alias("document_type"),
        overall_confidence(F.col("field_confidences")).alias("overall_confidence"),
        snippet(F.col(text), snippet_chars).alias("raw_text_snippet"),
    )


