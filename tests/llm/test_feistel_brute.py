"""Pseudonyms against an independent version in plain Python, for every kind of item."""

import datetime
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldledger.llm import feistel
from fieldledger.llm.feistel import pseudonymise
from tests.llm.conftest import make_docs

KEY = "some key"
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
MONTHS = "January February March April May June July August September October November December".split()


def mac(kind, turn, other):
    return hmac.new(hashlib.sha512(KEY.encode()).digest(), f"{kind}|{turn}|{other}".encode(), "sha512").hexdigest()


def shifted(text, digest):
    out = ""
    for i, c in enumerate(text):
        own = next((k for k in CLASSES if c in k), None)
        by = int(digest[i % 64 * 2 : i % 64 * 2 + 2], 16)
        out += own[(own.index(c) + by) % len(own)] if own else c
    return out


def permuted_text(text, kind):
    if len(text) == 1:
        return shifted(text, mac(kind, 0, ""))
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(1, 9):
        if turn % 2:
            left = shifted(left, mac(kind, turn, right))
        else:
            right = shifted(right, mac(kind, turn, left))
    return left + right


def permuted_number(value, sides, kind):
    a, b = sides
    left, right = divmod(value, b)
    for turn in range(1, 9):
        if turn % 2:
            left = (left + int(mac(kind, turn, right)[:15], 16)) % a
        else:
            right = (right + int(mac(kind, turn, left)[:15], 16)) % b
    return left * b + right


def luhn(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refilled(layout, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in CLASSES[0] else c for c in layout)


def iban_number(text):
    return int("".join(str(int(c, 36)) for c in text))


def date(item):
    """The first reading that is a date, and the writing of any date of that class, or None."""
    first = datetime.date(1800, 1, 1)
    long = {m: i for i, m in enumerate(MONTHS, 1)}
    pad = lambda d: (f"{d.day:02}", f"{d.month:02}")
    readings = [
        (r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)", lambda d: d.isoformat()),
        (r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>\d{4})", lambda d: "{}.{}.".format(*pad(d)) + str(d.year)),
        (r"(?P<d>\d\d)/(?P<m>\d\d)/(?P<y>\d{4})", lambda d: "{}/{}/".format(*pad(d)) + str(d.year)),
        (r"(?P<m>\d\d)/(?P<d>\d\d)/(?P<y>\d{4})", lambda d: "{1}/{0}/".format(*pad(d)) + str(d.year) if d.day > 12 else None),
        (
            r"(?P<d>[1-9]\d?)/(?P<m>[1-9]\d?)/(?P<y>\d{4})",
            lambda d: f"{d.day}/{d.month}/{d.year}" if min(d.day, d.month) < 10 else None,
        ),
        (
            r"(?P<m>[1-9]\d?)/(?P<d>[1-9]\d?)/(?P<y>\d{4})",
            lambda d: f"{d.month}/{d.day}/{d.year}" if d.day > 12 and d.month < 10 else None,
        ),
        (r"(?P<d>[1-9]\d?) (?P<m>[A-Z][a-z]+) (?P<y>\d{4})", lambda d: f"{d.day} {MONTHS[d.month - 1]} {d.year}"),
        (r"(?P<m>[A-Z][a-z]+) (?P<d>[1-9]\d?), (?P<y>\d{4})", lambda d: f"{MONTHS[d.month - 1]} {d.day}, {d.year}"),
    ]
    for layout, write in readings:
        found = re.fullmatch(layout, item)
        if not found:
            continue
        try:
            month = found["m"]
            day = datetime.date(int(found["y"]), long.get(month) or int(month), int(found["d"]))
        except ValueError:
            continue
        number = (day - first).days
        if not 0 <= number < 189 * 773 or write(day) != item:
            continue
        while True:
            number = permuted_number(number, (189, 773), "date")
            new = write(first + datetime.timedelta(number))
            if new:
                return new
    return None


def ssn(item):
    area, group, serial = map(int, item.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    value = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    area, rest = divmod(permuted_number(value, (898, 99 * 9999), "ssn"), 99 * 9999)
    group, serial = divmod(rest, 9999)
    area += 1
    return f"{area + (area >= 666):03}-{group + 1:02}-{serial + 1:04}"


def ip(item):
    octets = list(map(int, item.split(".")))
    if max(octets) > 255:
        return None
    new = permuted_number(int.from_bytes(bytes(octets)), (65536, 65536), "ip")
    return ".".join(map(str, new.to_bytes(4)))


def iban(item):
    plain = item.replace(" ", "")
    if iban_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    new = permuted_text(plain[4:], "iban")
    plain = plain[:2] + f"{98 - iban_number(new + plain[:2] + '00') % 97:02}" + new
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if " " in item else plain


def card(item):
    digits = re.sub(r"\D", "", item)
    if luhn(digits[:-1]) != digits[-1]:
        return None
    new = permuted_text(digits[:-1], "card")
    return refilled(item, new + luhn(new))


def email(item):
    name, host = item.split("@")
    return permuted_text(name, "email") + "@" + host


def phone(item, fixed):
    digits = re.sub(r"\D", "", item)
    return refilled(item, digits[:fixed] + permuted_text(digits[fixed:], "phone"))


def some_items(rng):
    """(item, pseudonym or None) of every kind."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    for _ in range(40):
        payload = rng.choice("3456") + digits(14)
        number = payload + luhn(payload)
        for item in (number, " ".join(re.findall("....", number)), "-".join(re.findall("....", number))):
            yield item, card(item)
        item = f"{rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04}"
        yield item, ssn(item)
        item = ".".join(str(rng.randint(0, 270)) for _ in range(4))
        yield item, ip(item)
        name = "".join(rng.choices("abcXYZ0189._-", k=rng.randint(0, 12)))
        yield f"q{name}@mail.example.org", email(f"q{name}@mail.example.org")
        body = "".join(rng.choices("0123456789ABCXYZ", k=18))
        for check in (f"{98 - iban_number(body + 'GB00') % 97:02}", "00"):
            item = "GB" + check + body
            yield item, iban(item)
        item = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}"
        yield item, phone(item, 0)
        item = f"+49 {rng.randint(30, 99)} {digits(3)} {digits(4)}"
        yield item, phone(item, 2)
    for _ in range(60):
        year, a, b = rng.randint(1790, 2210), rng.randint(1, 32), rng.randint(1, 32)
        for item in (
            f"{year}-{a:02}-{b:02}", f"{a:02}.{b:02}.{year}", f"{a:02}/{b:02}/{year}", f"{a}/{b}/{year}",
            f"{min(a, 31)} {MONTHS[b % 12]} {year}", f"{MONTHS[b % 12]} {min(a, 31)}, {year}",
        ):
            yield item, date(item)


def test_every_kind_matches_plain_python(spark):
    pairs = list(some_items(random.Random(8)))
    docs = make_docs(spark, [(i, f"see {item} there") for i, (item, _) in enumerate(pairs)])
    out = {r.doc_id: r.text for r in pseudonymise(docs, KEY).collect()}
    wrong = [(p, out[i]) for i, p in enumerate(pairs) if out[i] != f"see {p[1] or p[0]} there"]
    assert not wrong
    kinds = pseudonymise(docs, KEY).select(F.explode("found.kind").alias("k")).distinct().collect()
    assert {r.k for r in kinds} == set(feistel.LAYOUTS)


def test_dates_of_one_class_stay_apart(spark):
    """Month-first dates of 40 years: all pseudonyms differ and are month-first again."""
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(i) for i in range(14_000)]
    items = [f"{d.month:02}/{d.day:02}/{d.year}" for d in days if d.day > 12]
    out = [r.text for r in pseudonymise(make_docs(spark, list(enumerate(items))), KEY).collect()]
    assert len(set(out)) == len(items) and all(int(t[3:5]) > 12 for t in out)


@pytest.mark.parametrize(
    "text",
    ["a@" + "b." * 100_000 + "com", "a@" + "bb." * 100_000 + "com", "a@b.com." * 10_000, "@" * 100_000, "1.2.3.4." * 12_000,
     "+1 " * 2_000, "GB82 " * 4_000, "4" * 100_000, "a" * 100_000 + "@b.de", "0-" * 5_000, "(0" * 50_000, "1/" * 50_000],
)
def test_long_repeats_of_a_layout(spark, text):
    """Neither the stack nor the time gives out."""
    out = pseudonymise(make_docs(spark, [(1, text + " me@x.org")]), KEY).first()
    assert out.text.endswith("@x.org") and len(out.text) == len(text) + 9
