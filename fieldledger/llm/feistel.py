"""Format-preserving pseudonyms of personal numbers, dates and mail names by a keyed Feistel network.

Every found item is validated first (check digits, octet ranges, calendar), then permuted within
its own format, so that the result validates too and equal values get equal pseudonyms in all
documents, however they are punctuated.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Country codes of one and two digits (all others have three), and lengths of IBANs by country.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in countries.split()
}
#: Groups of a European phone number after its country code, and of one with a leading 0 instead.
_ABROAD = (
    r"\d(?:[ .-]\d{2}){4}|\d{1,3}[ .-]\d{3}(?:[ .-]\d{2}){2}|\d{2,5}(?:[ .-]\d{2}){3,4}"
    r"|\d{1,4}[ ./-]\d{3,4}[ .-]\d{3,4}|\d{2,5}[ ./-]\d{5,8}|\d{8,12}"
)
_AT_HOME = r"0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d{2,5}[ /-]\d{5,8}"
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
_MONTH = f"(?:{'|'.join(MONTHS)})"
_DAY = r"(?:[1-9]|[12]\d|3[01])"
#: Kinds of items in the order in which they are tried at a place, each with its layout.
LAYOUTS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.)++[A-Za-z]{2,24}\b",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": (
        r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
        rf"|{_DAY} {_MONTH} \d{{4}}|{_MONTH} {_DAY}, \d{{4}})(?![\w/-]|\.\d)"
    ),
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "phone": (
        rf"(?<![\w(])(?:(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}"
        rf"|(?:\+|00){_CODE}[ .-]?(?:\(0\) ?)?(?:{_ABROAD})|{_AT_HOME})(?![\w-])"
    ),
}
#: An IBAN in printed groups of four, as long as its country's are.
PRINTED_IBAN = "|".join(
    rf"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == size)})\d{{2}}(?: [A-Z0-9]{{4}}){{{size // 4 - 1}}}"
    + (f" [A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    for size in sorted(set(IBAN_LENGTHS.values()))
)
#: Digits of a run of numbers, unless another item starts there or the number goes on.
_NUMBER = (
    r"(?![A-Za-z0-9._%+-]{0,63}@|\d{1,2}/\d{1,2}/\d{4}(?![\w/-]|\.\d)|0\d{2,5}/\d{3})\d++(?!\w|\.\d|-(?!\d))"
)
#: Numbers side by side, which may be several items: 13 digits or more, or a printed IBAN and what follows it.
RUN_LAYOUT = (
    rf"(?<![\w.-])\+?(?=\d(?:[ -]?\d){{12}}){_NUMBER}(?:[ -]{_NUMBER})*+"
    rf"|(?<!\w)(?:{PRINTED_IBAN})(?!\w)(?:[ -]{_NUMBER})*+"
)
#: Usual groups of a card's digits; other groups are tried where nothing else fits, by number of digits in this order.
CARD_GROUPS = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}"
CARD_SIZES = (16, 15, 19, 18, 17, 14, 13)
#: Labels of a host name at most. A group that may be given back, and so is matched by recursion, needs such a bound.
HOST_LABELS = 127
#: Any item but those in runs of numbers, and any item or run; the mail name's characters are taken whole, so this has
#: no costly retries.
ANY_LAYOUT = "|".join(
    [LAYOUTS["email"].replace(")++", f"){{1,{HOST_LABELS}}}"), LAYOUTS["ip"], RUN_LAYOUT]
    + [LAYOUTS[k] for k in ("date", "ssn", "iban", "phone")]
)
#: Kind of a part that is no item.
BETWEEN = "between"
VALID_SSN = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
#: Layout and format of each kind of date. Slash dates are day first where that is a date, else month
#: first; a class is permuted within itself, so that no two dates get the same pseudonym.
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^(?:[1-9]/[1-9]\d?|[1-9]\d/[1-9])/\d{4}$", "d/M/yyyy"),
    (r"^(?:[1-9]/[1-9]\d?|[1-9]\d/[1-9])/\d{4}$", "M/d/yyyy"),
    (rf"^{_DAY} {_MONTH} \d{{4}}$", "d MMMM yyyy"),
    (rf"^{_MONTH} {_DAY}, \d{{4}}$", "MMMM d, yyyy"),
)
#: Times that a date is permuted again at most until it is of its class; a chance below 1e-25 of more.
WALK = 64
#: Days from 1800-01-01 to 2199-12-31 are 189 x 773; dates outside are left as they are.
FIRST_DAY, DATE_SIDES = "1800-01-01", (189, 773)
#: Valid areas (001-899 but 666), and groups and serials (neither all zero).
SSN_SIDES = (898, 99 * 9999)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _mac(key: str, kind: str, turn: Column, other: Column) -> Column:
    """Hex digest of one round, 128 characters: HMAC-SHA-512 of kind, turn and the other half under
    the digest of the key. Kind and turn hold no bar, so no two messages are alike."""
    secret = hashlib.sha512(key.encode()).digest().ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", F.lit(kind), turn.cast("string"), other.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _mac_number(*args) -> Column:
    return F.conv(F.substring(_mac(*args), 1, 15), 16, 10).cast("long")


def _shift(char: Column, by: Column) -> Column:
    """The character moved by so many places within its own class; others stay."""
    out = char
    for letters in (DIGITS, LOWER, UPPER):
        at = F.instr(F.lit(letters), char)
        out = F.when(
            at > 0, F.substring(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))
        ).otherwise(out)
    return out


def _shift_all(text: Column, mac: Column) -> Column:
    def moved(i):
        byte = F.conv(F.substring(mac, ((i - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return _shift(F.substring(text, i, F.lit(1)), byte)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), moved), "")


def permute_text(text: Column, key: str, kind: str) -> Column:
    """Permute a string of two characters or more within the classes of its characters."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r")
    )

    def turn(state, i):
        left = F.struct(_shift_all(state.l, _mac(key, kind, i, state.r)).alias("l"), state.r.alias("r"))
        right = F.struct(state.l.alias("l"), _shift_all(state.r, _mac(key, kind, i, state.l)).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    both = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s.l, s.r))
    alone = F.when(F.length(text) == 1, _shift_all(text, _mac(key, kind, F.lit(0), F.lit("")))).otherwise(text)
    return F.when(F.length(text) >= 2, both).otherwise(alone)


def permute_number(value: Column, sides: tuple[int, int], key: str, kind: str) -> Column:
    """Permute 0 .. a * b - 1 by a network whose halves are taken modulo a and modulo b."""
    a, b = sides
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))

    def turn(state, i):
        left = ((state.l + _mac_number(key, kind, i, state.r)) % a).cast("long")
        right = ((state.r + _mac_number(key, kind, i, state.l)) % b).cast("long")
        return F.when(i % 2 == 1, F.struct(left.alias("l"), state.r.alias("r"))).otherwise(
            F.struct(state.l.alias("l"), right.alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s.l * b + s.r)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_check_digit(payload: Column) -> Column:
    def add(total, i):
        d = F.substring(payload, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(payload) - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def iban_remainder(text: Column) -> Column:
    """Remainder modulo 97 of an IBAN that has its first four characters at the end."""

    def add(total, i):
        value = F.instr(F.lit(DIGITS + UPPER), F.substring(text, i, F.lit(1))) - 1
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def with_digits(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced, in order, by as many new ones."""

    def at(i):
        c = F.substring(layout, i, F.lit(1))
        place = F.length(_digits(F.substring(layout, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), at), "")


def _card(m: Column, key: str) -> Column:
    def body(d):
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = luhn_check_digit(payload) == F.substring(d, F.length(d), F.lit(1))
        new = _let(permute_text(payload, key, "card"), lambda p: F.concat(p, luhn_check_digit(p)))
        return F.when(valid, with_digits(m, new))

    return _let(_digits(m), body)


def _phone(m: Column, key: str) -> Column:
    """The country code and a leading 0 in its place or in brackets stay; the other digits are permuted."""
    fixed = F.length(_digits(F.regexp_extract(m, rf"^(?:(?:\+|00){_CODE}[ .-]?(?:\(0\))?|0)?", 0)))

    def body(d):
        code = F.substring(d, F.lit(1), fixed)
        return with_digits(m, F.concat(code, permute_text(F.substring(d, fixed + 1, F.length(d)), key, "phone")))

    return _let(_digits(m), body)


def _ip(m: Column, key: str) -> Column:
    def body(o):
        value = F.aggregate(o, F.lit(0).cast("long"), lambda total, x: total * 256 + x)

        def octets(n):
            return F.concat_ws(".", *((F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)))

        return F.when(F.array_max(o) <= 255, _let(permute_number(value, (65536, 65536), key, "ip"), octets))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), body)


#: Formats of which only some dates are written so; the others are read in an earlier format.
PART_CLASSES = {
    "MM/dd/yyyy": lambda day: F.dayofmonth(day) > 12,
    "d/M/yyyy": lambda day: (F.dayofmonth(day) < 10) | (F.month(day) < 10),
    "M/d/yyyy": lambda day: (F.dayofmonth(day) > 12) & (F.month(day) < 10),
}


def _in_class(day: Column, fmt: str) -> Column:
    return PART_CLASSES.get(fmt, lambda _: F.lit(True))(day)


def _date(m: Column, key: str) -> Column:
    def at(n):
        return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def moved(fmt):
        def body(d):
            # The first step always moves; further ones go on while the date is of another class.
            def step(n, i):
                again = permute_number(n, DATE_SIDES, key, "date")
                return F.when((i > 1) & _in_class(at(n), fmt), n).otherwise(again)

            if fmt in PART_CLASSES:
                new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), d, step)
            else:
                new = permute_number(d, DATE_SIDES, key, "date")
            inside = (d >= 0) & (d < DATE_SIDES[0] * DATE_SIDES[1])
            return F.when(inside, _let(new, lambda n: F.when(_in_class(at(n), fmt), F.date_format(at(n), fmt))))

        return body

    def tried(layout, fmt):
        day = F.datediff(F.try_to_timestamp(m, F.lit(fmt)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        return F.when(m.rlike(layout), _let(day.cast("long"), moved(fmt)))

    return F.coalesce(*(tried(layout, fmt) for layout, fmt in DATE_FORMATS))


def _ssn(m: Column, key: str) -> Column:
    def body(p):
        area, group, serial = p[0], p[1], p[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * SSN_SIDES[1] + (group - 1) * 9999 + serial - 1

        def text(n):
            a = F.floor(n / SSN_SIDES[1]).cast("long") + 1
            rest = n % SSN_SIDES[1]
            parts = (
                (a + F.when(a >= 666, 1).otherwise(0), 3),
                (F.floor(rest / 9999) + 1, 2),
                (rest % 9999 + 1, 4),
            )
            return F.concat_ws("-", *(F.lpad(x.cast("long").cast("string"), k, "0") for x, k in parts))

        return F.when(valid, _let(permute_number(place, SSN_SIDES, key, "ssn"), text))

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), body)


def _iban(m: Column, key: str) -> Column:
    """A printed IBAN keeps its blanks."""
    groups = lambda n: F.when(
        m.contains(" "), F.array_join(F.regexp_extract_all(n, F.lit(".{1,4}"), 0), " ")
    ).otherwise(n)
    return _let(_let(F.replace(m, F.lit(" "), F.lit("")), lambda p: _plain_iban(p, key)), groups)


def _plain_iban(m: Column, key: str) -> Column:
    country, bban = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))
    valid = iban_remainder(F.concat(bban, F.substring(m, 1, 4))) == 1

    def text(b):
        check = 98 - iban_remainder(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

    return F.when(valid, _let(permute_text(bban, key, "iban"), text))


def _email(m: Column, key: str) -> Column:
    """The name is permuted, the domain stays; case counts as it is written."""
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}


def pseudonym(item: Column, key: str, kind: Column | None = None) -> Column:
    """struct(kind, new) of one found item; null if it doesn't validate. An item of null kind has that of its layout."""

    def named(name):
        return lambda new: F.when(new.isNotNull(), F.struct(F.lit(name).alias("kind"), new.alias("new")))

    out = F.lit(None).cast("struct<kind:string,new:string>")
    for name in reversed(MAKERS):
        fits = item.rlike(f"^(?:{LAYOUTS[name]})$")
        fits = fits if kind is None else F.when(kind.isNull(), fits).otherwise(kind == name)
        out = F.when(fits, _let(MAKERS[name](item, key), named(name))).otherwise(out)
    return out


def _luhn_fits(text: Column) -> Column:
    return _let(
        _digits(text),
        lambda d: luhn_check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)),
    )


def _iban_fits(text: Column) -> Column:
    return _let(
        F.replace(text, F.lit(" "), F.lit("")),
        lambda p: iban_remainder(F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, 1, 4))) == 1,
    )


def _kind_at(text: Column, level: Column) -> Column:
    """The kind of a piece of a run that validates in this turn, or null."""
    is_like = lambda layout: text.rlike(f"^(?:{layout})$")
    card = F.when((level % 2 == 1) & is_like(CARD_GROUPS) | (level == 4) & is_like(LAYOUTS["card"]), _luhn_fits(text))
    iban = F.when((level % 2 == 1) & is_like(PRINTED_IBAN), _iban_fits(text))
    day = F.when((level == 2) & is_like(LAYOUTS["date"]), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull())
    ssn = (level == 2) & is_like(VALID_SSN)
    phone = (level == 2) & is_like(LAYOUTS["phone"])
    return F.when(card, "card").when(iban, "iban").when(day, "date").when(ssn, "ssn").when(phone, "phone")


_PART = "struct<text:string,kind:string>"


def _part(text: Column, kind: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(BETWEEN) if kind is None else kind).alias("kind"))


def _cut(run: Column, level: Column) -> Column:
    """A run of numbers as parts (text, kind) in order: items that validate, and what stands between them.

    At each number, all pieces of up to 19 numbers are tried; the most numbers count, and for cards
    the place in CARD_SIZES. In the first two turns no item may touch a hyphen.
    """

    def body(numbers):
        def best(number, at):
            before = F.coalesce(F.get(numbers, at - 1), F.lit("")).endswith("-")

            def tried(k):
                def piece(raw):
                    text = F.regexp_replace(raw, "[ -]$", "")
                    touches = before | (raw.endswith("-") & (at + k < F.size(numbers)))
                    kind = F.when((F.length(text) <= 40) & ~((level < 3) & touches), _kind_at(text, level))
                    size = F.array_position(F.array(*(F.lit(n) for n in CARD_SIZES)), F.length(_digits(text))).cast("int")
                    turn = F.when(level == 4, size).otherwise(-k)
                    return F.struct(turn.alias("turn"), k.alias("k"), kind.alias("kind"))

                return _let(F.array_join(F.slice(numbers, at + 1, k), ""), piece)

            pieces = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(numbers) - at)), tried)
            return F.array_min(F.filter(pieces, lambda x: x["kind"].isNotNull()))

        def between(first, last):
            text = F.array_join(F.slice(numbers, first + 1, last - first), "")
            return F.when(last > first, F.array(_part(text))).otherwise(F.array().cast(f"array<{_PART}>"))

        def chosen(bests):
            def step(state, at):
                def taken(b):
                    raw = F.array_join(F.slice(numbers, at + 1, b["k"]), "")
                    item = _part(F.regexp_replace(raw, "[ -]$", ""), b["kind"])
                    rest = _part(F.regexp_extract(raw, "[ -]?$", 0))
                    parts = F.concat(state["parts"], between(state["next"], at), F.array(item, rest))
                    return F.struct((at + b["k"]).alias("next"), parts.alias("parts"))

                return F.when((at >= state["next"]) & F.get(bests, at).isNotNull(), taken(F.get(bests, at))).otherwise(state)

            start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{_PART}>").alias("parts"))
            return F.aggregate(
                F.sequence(F.lit(0), F.size(numbers) - 1),
                start,
                step,
                lambda s: F.concat(s["parts"], between(s["next"], F.size(numbers))),
            )

        return _let(F.transform(numbers, best), chosen)

    numbers = F.filter(F.split(run, "(?<=[ -])", -1), lambda t: t != "")
    return F.when(run.rlike("[0-9]"), _let(numbers, body)).otherwise(F.array(_part(run)))


def item_parts(item: Column) -> Column:
    """Parts (text, kind) of one found item or run of numbers; a single item is one part of null kind.

    In a run, cards in their usual groups and printed IBANs come first, wherever they stand; then
    dates, social-security numbers and phones; then cards and IBANs beside hyphens, and at last cards
    in other groups.
    """

    def turn(parts, level):
        return F.flatten(
            F.transform(parts, lambda p: F.when(p["kind"] != BETWEEN, F.array(p)).otherwise(_cut(p["text"], level)))
        )

    run = F.aggregate(F.array(*(F.lit(level) for level in (1, 2, 3, 4))), F.array(_part(item)), turn)
    alone = F.array(_part(item, F.lit(None).cast("string")))
    return F.when(item.rlike(f"^(?:{RUN_LAYOUT})$"), run).otherwise(alone)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace ``text`` and add ``found`` array<struct<kind,new>>, one entry for each item replaced.

    ``key`` is the secret of the permutations. What is derived from it stands as literals in the plan,
    and so in the event log and the user interface, which need the same protection; the key itself
    does not. Dates with slashes count as day first where that is a date, else as month first. Numbers side by side are parted into the items among
    them. Items that don't validate, and everything between items, stay byte for byte. A null text
    stays null with ``found`` empty; other columns pass through. One pass over the rows, without a
    shuffle.
    """
    none = F.array().cast("array<struct<kind:string,new:string>>")
    marked = F.col(text).rlike("[0-9@]")
    items = F.when(marked, F.regexp_extract_all(F.col(text), F.lit(ANY_LAYOUT), 0))
    pieces = F.split(F.col(text), ANY_LAYOUT, -1)
    # What stands between the items is a part as well, so that one list holds the whole text.
    parts = F.flatten(
        F.zip_with(
            pieces,
            "__items",
            lambda piece, item: F.concat(
                F.array(_part(piece)),
                F.when(item.isNotNull(), item_parts(item)).otherwise(F.array().cast(f"array<{_PART}>")),
            ),
        )
    )
    work = docs.withColumn("__items", items)
    work = work.withColumn("__parts", F.when(F.size("__items") > 0, parts))

    def made(p):
        new = F.when(p["kind"].eqNullSafe(BETWEEN), None).otherwise(pseudonym(p["text"], key, p["kind"]))
        return F.struct(p["text"].alias("text"), new.alias("made"))

    work = work.withColumn("__made", F.transform("__parts", made))
    rebuilt = F.array_join(F.transform("__made", lambda p: F.coalesce(p["made"]["new"], p["text"])), "")
    replaced = F.transform(F.filter("__made", lambda p: p["made"].isNotNull()), lambda p: p["made"])
    return work.withColumns(
        {
            text: F.when(F.col("__made").isNotNull(), rebuilt).otherwise(F.col(text)),
            "found": F.coalesce(replaced, none),
        }
    ).drop("__items", "__parts", "__made")
