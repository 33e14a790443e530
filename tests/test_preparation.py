import json

from pyspark.sql import functions as F

from fieldledger.operators import admission, chatrows, filings, receipts, sections, validate
from fieldledger.plans import benchmarks

TENK = """ACME INC.
FORM 10-K

TABLE OF CONTENTS
Item 1.  Business ... 3
Item 1A. Risk Factors ... 12
Item 8.  Financial Statements ... 42

PART I

Item 1. Business

Acme makes things.

ITEM 1A - Risk Factors

Many risks.

item 8: Financial Statements

Revenue: 5
"""


def cut(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r for r in sections.with_sections(df, **kw).orderBy("i").collect()]


def test_sections_keep_the_last_heading(spark):
    (r,) = cut(spark, TENK)
    assert [s.item for s in r.sections] == ["1", "1A", "8"]
    assert r.sections[1].text.strip() == "Many risks." and "Revenue: 5" in r.sections[2].text
    assert r.sections[0].heading == "Item 1. Business"
    for s in r.sections:
        assert TENK[s.start : s.end].strip().startswith(s.heading)
    assert r.cover == TENK[: r.sections[0].start] and "Acme makes" not in r.cover


def test_section_edge_cases(spark):
    blank, none, swallowed, alone, nbsp = cut(
        spark, "  \n ", "no headings here", "Item 1\n\nItem 2\nbody", "Item 7.\nfirst line\nrest",
        "x\nItem 1A risk", cover_chars=5,
    )
    assert blank.sections == [] and blank.cover == ""
    assert none.sections[0].item == "0" and none.sections[0].text == "no headings here" and none.cover == "no he"
    assert [s.item for s in swallowed.sections] == ["1"]
    assert alone.sections[0].heading == "Item 7." and alone.sections[0].text == "\nfirst line\nrest"
    assert nbsp.sections[0].item == "1A"


def test_filing_request_has_placeholders(spark):
    df = spark.createDataFrame([("cover\nItem 8. F\nnumbers",)], "text string")
    m = sections.filing_requests(df, {"filing": "sys"}).first().messages
    assert [x.role for x in m] == ["system", "user"]
    assert "(Item 1A not found in this filing.)" in m[1].content and "numbers" in m[1].content


def flat(spark, *records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "pos long, raw string")
    return {r.pos: r for r in receipts.normalize_flat(df).collect()}


def test_flat_receipts(spark):
    good = {"company": " A  B ", "address": "1\tx", "date": "15/06/2026", "total": "SGD 45.00"}
    got = flat(
        spark, json.dumps(good), json.dumps({"parsed_data": good, "id": "r1"}),
        json.dumps({"ground_truth": json.dumps(good)}), json.dumps({**good, "total": ""}),
        json.dumps({**good, "company": " "}), json.dumps({**good, "total": "-3"}), "{nope",
        json.dumps({**good, "total": 0, "amount": 7}), json.dumps([1]),
    )
    assert [got[i].reason for i in range(9)] == [
        None, None, None, "missing_total", "missing_company", "negative_total", "invalid_json", None, "not_an_object",
    ]
    g = got[0].ground_truth
    assert (g.merchant, g.merchant_address.line1, g.total, g.currency) == ("A B", "1 x", 45.0, "SGD")
    assert str(g.transaction_date) == "2026-06-15" and got[0].id == "sroie_00000" and got[1].id == "r1"
    assert got[7].ground_truth.total == 7.0


def test_menu_receipts(spark):
    def rec(**kw):
        return json.dumps({"gt_parse": {"menu": [{"nm": "tea", "cnt": "2", "price": "5.00"}],
                                        "total": {"total_price": "5.00"}, **kw}})

    rows = [rec(), rec(menu={"nm": " one ", "unitprice": "1.00", "price": "3.00"}), rec(menu="x"),
            rec(menu=[{"nm": "", "price": "1"}, {"nm": "t", "cnt": "2 x"}]), rec(menu=[{"nm": "t", "cnt": "-1"}]),
            rec(total={"total_price": "", "cashprice": "9"}), rec(total={}), rec(menu=[1]),
            json.dumps({"ground_truth": rec(sub_total={"subtotal_price": "4", "tax_price": "1"})})]
    df = spark.createDataFrame(list(enumerate(rows)), "pos long, raw string")
    got = {r.pos: r for r in receipts.normalize_menu(df).collect()}
    assert [got[i].reason for i in range(9)] == [
        None, None, None, None, "negative_quantity", None, "missing_total", "bad_menu_entry", None,
    ]
    (tea,) = got[0].ground_truth.line_items
    assert (tea.description, tea.quantity, tea.unit_price, tea.total) == ("tea", 2.0, 5.0, 5.0)
    (one,) = got[1].ground_truth.line_items
    assert (one.description, one.unit_price, one.total) == ("one", 1.0, 3.0)
    assert got[2].ground_truth.line_items == [] and got[3].ground_truth.line_items[0].quantity is None
    assert got[0].ground_truth.merchant == "Unknown merchant" and got[0].ground_truth.currency == "KRW"
    assert got[5].ground_truth.total == 9.0 and got[8].ground_truth.tax == 1.0


def test_menu_entries_are_opened_by_one_cast(spark):
    """an entry is not searched by path once per use of a member."""
    rows = [{"menu": m, "total": {"total_price": "1"}} for m in (
        [{"nm": "a", "price": "2"}, None], [3], {"nm": "b", "cnt": None, "unitprice": 0, "price": 2.5}, "x", [{"nm": 0, "price": "1"}],
    )]
    normalized = receipts.normalize_menu(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, raw string"))
    assert "$.unitprice" not in normalized._jdf.queryExecution().analyzed().toString()
    got = {r.pos: r for r in normalized.collect()}
    assert [got[i].reason for i in range(5)] == ["bad_menu_entry", "bad_menu_entry", None, None, None]
    (b,) = got[2].ground_truth.line_items
    assert (b.description, b.quantity, b.unit_price, b.total) == ("b", None, 2.5, 2.5)
    assert got[3].ground_truth.line_items == [] and got[4].ground_truth.line_items == []


def reasons(spark, doc_type, *datas):
    rows = [(i, d if isinstance(d, str) else json.dumps({"data": d})) for i, d in enumerate(datas)]
    df = spark.createDataFrame(rows, "i int, raw string")
    return {r.i: r for r in validate.validate_envelopes(df, doc_type).collect()}


def test_validation_of_receipts(spark):
    ok = {"merchant": " M ", "total": "12.345", "currency": " usd "}
    got = reasons(
        spark, "receipt", ok, {**ok, "extra": 1}, {**ok, "total": None}, {**ok, "merchant": 5}, {**ok, "total": -1},
        {**ok, "line_items": [{"description": "d", "quantity": -1}, 3]}, {**ok, "currency": "  "},
        {**ok, "transaction_date": "2020-02-30", "transaction_time": "25:00"}, {"total": 1}, "[]", "{", "{}",
        {**ok, "merchant_address": {"zip": 1}}, {**ok, "transaction_time": "09:30", "line_items": None},
    )
    assert got[0].reasons == [] and got[0].data.total == round(12.345, 2)
    assert (got[0].data.merchant, got[0].data.currency, got[0].data.line_items) == ("M", "USD", [])
    want = {
        1: ["extra:data.extra"], 2: ["null:data.total"], 3: ["type:data.merchant"], 4: ["range:data.total"],
        5: ["range:data.line_items[].quantity", "type:data.line_items[]"], 6: ["type:data.currency"],
        7: ["type:data.transaction_date", "type:data.transaction_time"],
        8: ["missing:data.currency", "missing:data.merchant"], 9: ["type:envelope"], 10: ["invalid_json"],
        11: ["missing:data"], 12: ["extra:data.merchant_address.zip"], 13: ["null:data.line_items"],
    }
    assert {i: got[i].reasons for i in want} == want
    assert got[1].data is None


def test_validation_of_filings(spark):
    risk = {"theme": "t", "summary": "s"}
    ok = {"cover": {"company_name": "A", "cik": 320193, "ticker": " aapl "}, "financials": {"fiscal_year": "2024"}}
    got = reasons(
        spark, "filing", ok, {**ok, "top_risk_factors": [risk] * 6}, {**ok, "financials": {"fiscal_year": 1800}},
        {**ok, "financials": {"currency": None, "revenue": 1.005}}, {"cover": None, "financials": []},
    )
    d = got[0].data
    assert (d.cover.cik, d.cover.ticker, d.cover.form_type) == ("0000320193", "AAPL", "10-K")
    assert (d.financials.currency, d.financials.fiscal_year) == ("USD", 2024)
    assert got[1].reasons == ["range:data.top_risk_factors"]
    assert got[2].reasons == ["range:data.financials.fiscal_year"]
    assert got[3].data.financials.currency == "USD" and got[3].data.financials.revenue == 1.0
    assert got[4].reasons == ["null:data.cover", "type:data.financials"]


def test_validation_moves_no_row(spark):
    """An envelope stays one row of one partition, however many list elements it has (F8, F16, F22)."""
    item = {"description": "d", "quantity": 1, "total": 2.005}
    ok = {"invoice_number": "1", "vendor": {"name": "v"}, "total": 1, "currency": "x", "line_items": [item] * 300}
    bad = {**ok, "line_items": [item, {**item, "odd\u0000key": 1}, None], "vendor": {"name": True, "address": {"city": 1}}}
    rows = [(i, json.dumps({"data": d, "warnings": {}} if i == 2 else {"data": d})) for i, d in enumerate([ok, bad, ok])]
    checked = validate.validate_envelopes(spark.createDataFrame(rows, "i int, raw string"), "invoice")
    assert "Exchange" not in checked._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r for r in checked.collect()}
    assert got[0].reasons == [] and {x.total for x in got[0].data.line_items} == {2.0} and len(got[0].data.line_items) == 300
    assert got[1].reasons == [
        "extra:data.line_items[].odd\u0000key", "type:data.line_items[]", "type:data.vendor.address.city", "type:data.vendor.name",
    ]
    assert got[2].reasons == ["type:warnings"] and got[0].warnings == []


def test_filing_checks_are_spread(spark):
    """envelopes are checked in as many tasks as the session asks for, not one per split of the file."""
    plan = benchmarks.validate_filings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderkey" in plan


def test_admission_order(spark):
    rows = [("a.pdf", 1, "invoice", None), ("a.pdf", 1, "memo", None), ("a.exe", 0, "invoice", None),
            ("a.TXT", 0, " Receipt", ""), ("a.png", 11 * 2**20, "filing", "image/png"), ("a.png", 1, "filing", "text/html")]
    df = spark.createDataFrame(rows, "filename string, length long, doc_type string, content_type string")
    assert [r.status for r in admission.admit(df).collect()] == [200, 400, 415, 422, 413, 415]
    files = spark.createDataFrame(
        [("x.txt", bytearray(b" caf\xc3\xa9 \xff ")), ("x.bin", bytearray(b"%PDF-1")), ("x.md", bytearray(b" "))],
        "filename string, content binary",
    )
    got = [(r.source_type, r.page_count, r.text) for r in admission.route(files).collect()]
    assert got == [("text", 1, "café �"), ("pdf", None, ""), ("empty", 0, "")]


def test_split_is_exact_and_stable(spark):
    for n, val in ((10, 2), (1, 1), (3, 1), (997, 199)):
        df = spark.range(n).withColumnRenamed("id", "doc_id")
        one = chatrows.split(df.coalesce(1), ["doc_id"], 0.2, bits=3).where("split = 'val'")
        many = chatrows.split(df.repartition(7), ["doc_id"], 0.2, bits=3).where("split = 'val'")
        ids = sorted(r.doc_id for r in one.collect())
        assert len(ids) == val and ids == sorted(r.doc_id for r in many.collect())
    assert chatrows.split(spark.range(5), ["id"], 0).where("split = 'val'").count() == 0


def test_chat_rows(spark):
    df = spark.createDataFrame([("a", "text", '{"x":"é"}'), ("b", "", "{}"), ("c", "t", None)],
                               "id string, text string, ground_truth string")
    got = {r.id: r for r in chatrows.chat_rows(df, "receipt", {"receipt": "sys"}).collect()}
    m = got["a"].messages
    assert [x.role for x in m] == ["system", "user", "assistant"]
    assert m[2].content == '{"data":{"x":"\\u00e9"},"field_confidences":[],"warnings":[]}'
    assert m[1].content.endswith("---BEGIN DOCUMENT TEXT---\ntext\n---END DOCUMENT TEXT---")
    assert (got["b"].problem, got["c"].problem) == ("no_text", "empty_ground_truth")


def test_nested_facts(spark):
    entry = lambda v, **kw: {"end": "2024-12-31", "form": "10-K", "fp": "FY", "val": v, **kw}
    facts = {"facts": {"us-gaap": {
        "SalesRevenueNet": {"units": {"USD": [entry(1)]}},
        "Revenues": {"units": {"USD": [entry(5, fp="Q3"), entry("bad"), entry(7, form="10-K/A"), entry(8)]}},
        "LongTermDebt": {"units": {"USD": [entry(10)]}}, "Deposits": {"units": {"EUR": [entry(2)]}},
        "Assets": {"units": {"USD": [entry(3, end="2023-12-31")]}}, "Other": {"units": {"USD": [entry(9)]}},
    }}}
    df = spark.createDataFrame([("s", json.dumps(facts))], "stem string, j string")
    nested = df.select("stem", F.from_json("j", filings.FACTS_TYPE).alias("facts"))
    values = filings.annual_values(filings.explode_facts(nested, "stem"), "stem")
    periods = spark.createDataFrame([("s", "2024-12-31"), ("none", "2024-12-31")], "stem string, fy_end string")
    got = {r.stem: r for r in filings.financials(values, periods, "stem").collect()}
    assert (got["s"].revenue, got["s"].total_debt, got["s"].total_assets) == (7.0, 12.0, None)
    assert got["none"].revenue is None and got["none"].fiscal_year == 2024
