"""Text clean-up as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the characters counted as white space (Unicode, including the four separators
# U+001C..U+001F that Java's \s leaves out).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WS_RUN = f"[{WHITESPACE}]+"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` written and evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Collapse white space to single blanks; nothing left means null."""
    return let(F.btrim(F.regexp_replace(c, WS_RUN, " "), F.lit(" ")), blank_to_null)


def upper_code(c: Column) -> Column:
    """Trimmed, upper-cased code (currency, ticker, state); blank means null."""
    return let(F.upper(strip(c)), blank_to_null)


def filing_currency(c: Column) -> Column:
    return F.coalesce(upper_code(c), F.lit("USD"))


def pad_cik(c: Column) -> Column:
    """Left-pad an all-digit company key to ten digits, leave anything else alone."""
    return let(
        strip(c), lambda s: F.when(s.rlike("^[0-9]{1,9}$"), F.lpad(s, 10, "0")).otherwise(s)
    )


def normalize(c: Column) -> Column:
    """Form in which strings are compared."""
    return F.lower(strip(c))


def snippet(c: Column, limit: int | None = None) -> Column:
    """Source text kept beside an extraction, at most its first ``limit`` characters (default:
    all of it); null when there is none."""
    return blank_to_null(c if limit is None else F.substring(c, 1, limit))


def ascii_json(c: Column) -> Column:
    """Escape every non-ASCII character of a JSON text as \\uXXXX."""
    escaped = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                ch.rlike(r"[^\x00-\x7f]"),
                F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1"),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(r"[^\x00-\x7f]"), escaped).otherwise(c)


def doc_type_key(c: Column) -> Column:
    return F.lower(strip(c))
