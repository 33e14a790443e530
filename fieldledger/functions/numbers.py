"""Money and date parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldledger.functions.text import let, strip

# Accepted date layouts, tried in this order. The second entry of each pair is
# the shape the text must have, so that a four-digit-year layout never reads a two-digit year.
DATE_LAYOUTS = (
    ("yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("yyyy/M/d", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("d-M-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("M-d-yyyy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("d-M-yy", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$"),
    ("d/M/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} +[0-9]{1,2}, *[0-9]{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} +[0-9]{1,2}, *[0-9]{4}$"),
    ("d MMM yyyy", r"^[0-9]{1,2} +[A-Za-z]{3} +[0-9]{4}$"),
    ("d MMMM yyyy", r"^[0-9]{1,2} +[A-Za-z]{3,9} +[0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
)


def round_exact(c: Column, places: int) -> Column:
    """Round a double by its exact binary value, exact ties to even (2.675 -> 2.67).

    The built-in ``round`` works on the shortest decimal text instead (2.675 -> 2.68). Here the
    fraction is split so that its distance from the midpoint has an exact sign.
    """
    unit, scale = float(10**places), float(2 * 10**places)

    def body(x: Column) -> Column:
        def from_scaled(k: Column) -> Column:
            return F.signum(x) * k / F.lit(unit)

        def settle(v: Column) -> Column:
            below, side = v["below"], v["side"]
            up = (side > 0) | ((side == 0) & (below % 2 == 1))
            return from_scaled(F.when(up, below + 1.0).otherwise(below))

        size = F.abs(x)
        scaled = size * F.lit(unit)
        below = F.floor(scaled).cast("double")
        whole = F.floor(size).cast("double")
        coarse = F.floor((size - whole) * F.lit(2.0**26)).cast("double") / F.lit(2.0**26)
        midpoint = below * 2.0 + 1.0 - whole * F.lit(scale)
        side = (coarse * F.lit(scale) - midpoint) + (size - whole - coarse) * F.lit(scale)
        near_tie = F.abs(scaled - below - 0.5) < 1e-3

        def settle_large(v: Column) -> Column:
            below, rest = F.floor(v["part"]).cast("double"), v["part"] - F.floor(v["part"])
            odd = (v["whole"] * (unit % 2) + below) % 2 == 1
            up = (rest > 0.5) | ((rest == 0.5) & odd)
            return F.signum(x) * (v["whole"] + F.when(up, below + 1.0).otherwise(below) / F.lit(unit))

        # Above 2**40 the fraction has so few bits that its product with the unit is exact.
        large = let(F.struct(whole.alias("whole"), ((size - whole) * F.lit(unit)).alias("part")), settle_large)
        exact = let(F.struct(below.alias("below"), side.alias("side")), settle)
        return (
            F.when(F.isnan(x) | (size >= 2.0**53), x)
            .when(scaled > 2.0**40, large)
            .when(near_tie, exact)
            .otherwise(from_scaled(F.floor(scaled + 0.5)))
        )

    return let(c.cast("double"), body)


def round_money(c: Column) -> Column:
    return round_exact(c, 2)


def fixed_4(c: Column) -> Column:
    """Number as text with at most four decimals and no trailing zeros."""
    # Most numbers print with at most four decimals as they are; only the others are rounded.
    plain = c.cast("double").cast("string")
    shown = F.regexp_replace(F.format_string("%.4f", round_exact(c, 4)), r"\.?0+$", "")
    return F.when(plain.rlike(r"^-?[0-9]+\.[0-9]{1,4}$"), F.regexp_replace(plain, r"\.0$", "")).when(
        c.isNotNull(), shown
    )


def fixed(c: Column, places: int, before: str = "", after: str = "") -> Column:
    """Number as text with a fixed number of decimals; null stays null."""
    shown = F.format_string(f"{before}%.{places}f{after}", round_exact(c, places))
    return F.when(c.isNotNull(), shown)


def percent(c: Column, places: int) -> Column:
    return fixed(c * 100, places, after="%%")


def parse_money(c: Column) -> Column:
    """Amount in a messy string, or null.

    Everything but digits, separators and minus signs is dropped. Whichever of comma and dot
    stands last is the decimal separator, the other one only groups digits.
    """
    kept = F.regexp_replace(c.cast("string"), r"[^0-9.,\-]", "")

    def plain(s: Column) -> Column:
        comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
        comma_is_decimal = (comma > 0) & ((dot == 0) | (comma < dot))
        european = F.translate(F.translate(s, ".", ""), ",", ".")
        return F.when(comma_is_decimal, european).otherwise(F.translate(s, ",", ""))

    return round_exact(let(kept, plain).try_cast("double"), 2)


def parse_date(c: Column) -> Column:
    """Date in one of the accepted layouts (first that fits wins), or null."""

    def attempts(s: Column) -> Column:
        squeezed = F.regexp_replace(F.regexp_replace(s, " +", " "), ", *", ", ")
        tries = []
        for layout, shape in DATE_LAYOUTS:
            parsed = F.when(s.rlike(shape), F.try_to_date(squeezed, layout))
            if "yyyy" not in layout:
                parsed = let(parsed, _last_century)
            tries.append(parsed)
        return F.coalesce(*tries)

    return let(strip(c), attempts)


def _last_century(d: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
