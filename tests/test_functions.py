import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldledger.functions import html, labels, numbers, similarity, text

MONEY = [
    ("$12.99", 12.99), ("12.99", 12.99), ("12.999", 13.0), ("SGD 45.00", 45.0),
    ("1,299.50", 1299.5), ("1.299,50", 1299.5), ("12,99", 12.99), ("£10", 10.0), (None, None),
    ("", None), ("total:", None), ("abc", None), ("1299", 1299.0), ("1,299", 1.3),
    ("45,000", 45.0), ("1,234,567", None), ("(5.00)", 5.0), ("12-99", None), ("2 x 5.00", 25.0),
]
JUNE_15 = datetime.date(2026, 6, 15)
DATES = [
    ("2026-06-15", JUNE_15), ("15/06/2026", JUNE_15), ("06-15-2026", JUNE_15),
    ("Jun 15, 2026", JUNE_15), ("15 June 2026", JUNE_15), ("20260615", JUNE_15),
    (" 2026/6/15 ", JUNE_15), (None, None), ("", None), ("nonsense", None),
    ("15-06-75", datetime.date(1975, 6, 15)), ("15-06-26", JUNE_15), ("06/15/26", None),
    ("05/06/2018", datetime.date(2018, 6, 5)), ("31/02/2020", None), ("15-06-0026x", None),
]


def run(spark, rows, dtype, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {dtype}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    got = run(spark, [m for m, _ in MONEY], "string", numbers.parse_money)
    assert got == [w for _, w in MONEY]


def test_dates(spark):
    got = run(spark, [d for d, _ in DATES], "string", numbers.parse_date)
    assert got == [w for _, w in DATES]


@pytest.mark.parametrize("places", [0, 2, 4])
def test_rounding_follows_the_exact_binary_value(spark, places):
    rng = random.Random(places)
    xs = [2.675, 0.125, 0.375, 1.005, -2.675, 0.5, 1.5, 2.5, 0.0]
    xs += [rng.randint(0, 10**7) / 1000 for _ in range(3000)]
    xs += [rng.randint(0, 10**6) / rng.randint(1, 5000) for _ in range(3000)]
    xs += [rng.randint(10**9, 10**14) + rng.randint(0, 63) / 64 for _ in range(3000)]
    xs += [12345678901.125, 391035000000.125, -391035000000.375, 2.0**53 + 2, 1e300]
    assert run(spark, xs, "double", lambda c: numbers.round_exact(c, places)) == [
        round(x, places) for x in xs
    ]


def test_text_cleaning(spark):
    assert run(spark, ["  a  \n b ", " ", None], "string", text.clean_text) == ["a b", None, None]
    assert run(spark, [" usd ", "  ", None], "string", text.upper_code) == ["USD", None, None]
    assert run(spark, ["eur", "", None], "string", text.filing_currency) == ["EUR", "USD", "USD"]
    ciks = run(spark, ["320193", " 0000320193 ", "12345678901", "CIK1", None], "string", text.pad_cik)
    assert ciks == ["0000320193", "0000320193", "12345678901", "CIK1", None]
    shown = run(spark, [5.0, 12.5, 1234.5678, None, 100.0], "double", numbers.fixed_4)
    assert shown == ["5", "12.5", "1234.5678", None, "100"]
    ascii_ = run(spark, ['{"a":"Größe 😀"}', "plain"], "string", text.ascii_json)
    assert ascii_ == ['{"a":"Gr\\u00f6\\u00dfe \\ud83d\\ude00"}', "plain"]


def test_labels(spark):
    specs = ["m:minimal", " m ", "m: ", "a:b:c"]
    assert run(spark, specs, "string", labels.model_of) == ["m", "m", "m", "a"]
    assert run(spark, specs, "string", labels.effort_of) == ["minimal", None, None, "b:c"]
    tag = run(spark, ["org/m"], "string", lambda c: labels.report_tag(F.lit("receipt"), c))
    assert tag == ["receipt_org_m"]


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 90)))
        b = "".join(rng.choices("abcd ", k=rng.randint(0, 90)))
        assert similarity.lcs_length(a, b) == lcs_by_table(a, b)


@pytest.mark.parametrize(
    "p,t,score",
    [
        ("exxon mobil corporation", "exxon mobil corp", 0.821),
        ("lot 276 jalan banting", "lot 276 jalan banting, 43800 dengkil, selangor", 0.765),
        ("fy", "10-k", 0.0),
        ("tan woon yann sdn bhd", "tan woon yann", 1.0),
        ("", "x", 0.0),
    ],
)
def test_token_set_similarity(p, t, score):
    assert round(similarity.token_set_similarity(p, t), 3) == score


PAGES = [
    "<p>a</p><p>b</p>",
    "<p>a</p> \n <p>b&amp;c &copy; &middot;</p>",
    "x<script>var a='</p>';if(a<b){}</script>y<!-- <nav> -->z",
    "<header><nav>n</nav>h</header>body<footer>f</footer>",
    "<nav>one<nav>two</nav>three</nav>after",
    "<nav>never closed <p>text",
    "1 < 2 &eacute; &#233; <b title='a>b'>bold</b>",
    "<div>a<br/>b<br>c</div>\r\n\r\n\r\n<pre>  keep  </pre>",
    "<![CDATA[data]]><?pi x?>t<template>no</template>",
    "",
]


def test_html_paths_agree(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.text for r in html.with_html_text(df).collect()}
    for i, page in enumerate(PAGES):
        lines = [line.rstrip() for line in html.page_nodes(page).splitlines()]
        kept = [x for j, x in enumerate(lines) if x or (j and lines[j - 1])]
        assert got[i] == "\n".join(kept).strip() + "\n", page
    assert got[0] == "a\nb\n" and got[1] == "a\n\nb&c © ·\n" and got[2] == "x\ny\nz\n"
    assert got[3] == "body\n" and got[4] == "after\n" and got[5] == "\n"
