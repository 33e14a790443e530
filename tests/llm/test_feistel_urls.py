import re
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldledger.llm import feistel, url_filter
from tests.llm.conftest import make_docs

KEY = "k"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def one(spark, text):
    return feistel.pseudonymise(make_docs(spark, [(1, text)]).select("doc_id", "text"), KEY).first()


def test_kinds_keep_their_format(spark):
    text = (
        "Card 4532 0151 1283 0366, again 4532015112830366; mail jo.doe99@mail.example.com! Call +1 (988) 555-2485."
        " Host 10.20.30.40, born 1999-12-31 or 31.12.1999 or 31/12/1999. SSN 123-45-6789 IBAN GB82WEST12345698765432."
    )
    row = one(spark, text)
    new = row.text
    assert [x.kind for x in row.found] == ["card", "card", "email", "phone", "ip", "date", "date", "date", "ssn", "iban"]
    assert re.sub(r"\d", "9", re.sub(r"\d{1,3}(\.\d{1,3}){3}", "IP", new)).split("mail")[0] == re.sub(r"\d", "9", text).split("mail")[0]
    spaced, plain = row.found[0].new, row.found[1].new
    assert luhn(plain) and spaced.replace(" ", "") == plain != "4532015112830366"
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d\d@mail\.example\.com", row.found[2].new)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", row.found[3].new) and row.found[3].new != "+1 (988) 555-2485"
    assert all(int(x) < 256 for x in row.found[4].new.split("."))
    iso = date.fromisoformat(row.found[5].new)
    assert row.found[6].new == iso.strftime("%d.%m.%Y") and row.found[7].new == iso.strftime("%d/%m/%Y")
    assert iso != date(1999, 12, 31)
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", row.found[8].new)
    assert iban_ok(row.found[9].new) and row.found[9].new.startswith("GB")
    # What stands between the items is unchanged.
    assert new.startswith("Card ") and new.endswith(".") and " Host " in new and " SSN " in new


INVALID = [
    "4532015112830367",  # wrong check digit
    "300.1.1.1", "1.2.3.4.5", "2021-02-30", "99.99.2020", "1799-12-31", "000-12-3456", "666-12-3456", "123-00-4567",
    "GB82WEST12345698765433", "version 2.0", "page 12", "a@b", "",
]


def test_invalid_items_stay(spark):
    docs = make_docs(spark, list(enumerate(INVALID))).select("doc_id", "text")
    rows = {r.doc_id: r for r in feistel.pseudonymise(docs, KEY).collect()}
    assert [rows[i].text for i in range(len(INVALID))] == INVALID
    assert all(r.found == [] for r in rows.values())


@pytest.mark.parametrize("sides", [(7, 31), (64, 64), (5, 200)])
def test_numbers_are_permuted_without_collisions(spark, sides):
    n = sides[0] * sides[1]
    out = spark.range(n).select(feistel.permute_number(F.col("id"), sides, KEY, "date").alias("p"))
    assert sorted(r.p for r in out.collect()) == list(range(n))


def test_texts_are_permuted_without_collisions(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    first = [r.p for r in rows.select(feistel.permute_text(F.col("t"), KEY, "card").alias("p")).collect()]
    assert sorted(first) == [f"{i:03d}" for i in range(1000)]
    other = [r.p for r in rows.select(feistel.permute_text(F.col("t"), "other", "card").alias("p")).collect()]
    assert sum(a != b for a, b in zip(first, other, strict=True)) > 950


def test_equal_values_stay_linked_and_odd_rows_pass(spark, tricky_rows):
    rows = [*tricky_rows, (50, "see 8.8.4.4 now"), (51, "8.8.4.4"), (52, "4532015112830366 " * 500)]
    docs = make_docs(spark, rows)
    out = feistel.pseudonymise(docs, KEY)
    assert set(out.columns) == set(docs.columns)  # a column named found is replaced
    found = defaultdict(set)
    for r in out.collect():
        for x in r.found:
            found[r.doc_id].add(x.new)
        if r.doc_id not in (50, 51, 52):
            assert (r.doc_id, r.text) in tricky_rows
    assert found[50] == found[51] and len(found[52]) == 1
    assert feistel.pseudonymise(docs.limit(0), KEY).count() == 0


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [
        (len(text), text, action)
        for action, text in RULES
        for name, rest in [text.split("/", 1)]
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://a.EXAMPLE.org/es/1", "https://example.org/en/12?x#y",
        "http://x.com/de/1", "http://x.com/fr/", "http://x.com/frx", "http://com/de/", "http://notcom/de/", "http://É.org/",
        "a://b.org/c://d", "http://x.org?q=/es/", "http://x.example.org#/es/", "http://user@x.org:80/p", "\nhttp://x.org/a\nb",
        "http://" + "long" * 5000 + ".com/de/" + "p" * 50_000,
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    model = url_filter.train(url_filter.default_labelled(spark))
    rows = {r.page_id: r for r in url_filter.judge(pages, RULES, model).collect()}
    for i, u in enumerate(urls):
        host, path = brute_parts(u)
        rule, action = brute_rule(host, path)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), RULES, model).count() == 0


def test_hosts_that_were_not_seen(spark):
    model = url_filter.train(url_filter.default_labelled(spark))
    bad = ["http://casino-win.example.net/en/3", "http://www.cheap-pills.example.net/de/9", "http://free-bets.example.net/en/77",
           "http://adult-x.example.net/fr/4", "https://m.ads-track.example.net/en/8", "http://spam-farm.example.net/en/1"]
    good = ["http://weather.example.net/en/3", "https://blog.garden.example.net/de/9", "http://m.museum.example.net/fr/4",
            "http://www.history.example.net/es/8", "http://library.example.net/en/61", "http://recipes.example.net/en/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(pages, (), model).collect()}
    assert [verdicts[i] for i in range(12)] == ["block"] * 6 + ["allow"] * 6


BESIDE = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005"],
    "phone": ["555-123-4567", "+1 555 123 4567", "+49 30 1234567", "+33 1 23 45 67 89", "+44 20 7946 0958", "030 1234567"],
    "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034"],
    "date": ["1999-12-31", "31.12.1999", "31/12/1999"],
    "ssn": ["123-45-6789"],
    "ip": ["10.20.30.40"],
    "email": ["12jo@mail.example.com"],
}


def test_numbers_directly_beside_an_item(spark):
    """A short number before or after an item, or another item, neither hides it nor is changed."""
    cases = []
    for kind, items in BESIDE.items():
        for item in items:
            cases += [(kind, item, a, b) for a, b in [("", ""), ("", " 12/25"), ("", " 737"), ("", " 2024"), ("12 ", ""), ("2024 ", " 5")]]
    cases += [("card", "4111 1111 1111 1111", "", "-737"), ("card", "4111111111111111", "x1 77-", "")]
    docs = make_docs(spark, [(i, f"see {a}{item}{b} now") for i, (_, item, a, b) in enumerate(cases)])
    rows = {r.doc_id: r for r in feistel.pseudonymise(docs.select("doc_id", "text"), KEY).collect()}
    alone = {}
    for i, (kind, item, a, b) in enumerate(cases):
        r = rows[i]
        assert [x.kind for x in r.found] == [kind], (cases[i], r)
        assert r.text == f"see {a}{r.found[0].new}{b} now", (cases[i], r)
        assert r.found[0].new == alone.setdefault(item, r.found[0].new) != item
        if kind == "iban":
            assert iban_ok(r.found[0].new.replace(" ", "")) and [len(g) for g in r.found[0].new.split()] == [len(g) for g in item.split()]
        if kind == "card":
            assert luhn(re.sub(r"\D", "", r.found[0].new))


def test_items_side_by_side(spark):
    items = [(k, x) for k, v in BESIDE.items() for x in v]
    pairs = [(a, b) for a in items for b in items]
    docs = make_docs(spark, [(i, f"{a[1]} {b[1]}") for i, (a, b) in enumerate(pairs)])
    rows = {r.doc_id: r for r in feistel.pseudonymise(docs.select("doc_id", "text"), KEY).collect()}
    wrong = [(p, rows[i].found) for i, p in enumerate(pairs) if [x.kind for x in rows[i].found] != [p[0][0], p[1][0]]]
    assert wrong == []
    assert one(spark, "4111 1111 1111 1111 " * 300 + "12").text.count("4111 1111 1111 1111") == 0
    assert one(spark, "BE12 4111 1111 1111 1111 12").text.endswith(" 12")
    assert [x.kind for x in one(spark, "BE12 4111 1111 1111 1111 12").found] == ["card"]
