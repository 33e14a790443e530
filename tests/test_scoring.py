import json

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import flatten, infer, score
from fieldledger.schemas import RECEIPT, field_types, get_schema, struct_type

TRUTH_TYPE = struct_type(RECEIPT, raw=True)
DATA_TYPE = struct_type(RECEIPT)


def receipt(**kw):
    return json.dumps({"merchant": "Shop", "total": 10.0, "currency": "USD", **kw})


def frames(spark, cases):
    """cases: (doc_id, truth json, prediction json or None, error or None)"""
    df = spark.createDataFrame(cases, "doc_id string, t string, p string, error string")
    from pyspark.sql.types import DateType

    assert isinstance(DATA_TYPE["transaction_date"].dataType, DateType)
    truth = df.select(F.lit("d").alias("dataset"), "doc_id", F.from_json("t", TRUTH_TYPE).alias("truth"))
    preds = df.where("p is not null or error is not null").select(
        F.lit("m").alias("model"),
        F.lit(None).cast("string").alias("effort"),
        F.lit("d").alias("dataset"),
        "doc_id",
        F.from_json("p", DATA_TYPE).alias("data"),
        "error",
        F.lit(2.0).alias("latency_ms"),
        F.lit(1000).alias("input_tokens"),
        F.lit(1000).alias("output_tokens"),
    )
    return truth, preds


def pairs(spark, cases):
    truth, preds = frames(spark, cases)
    return score.with_cost(score.pair_documents(truth, preds, [("m", None)]))


def outcomes(spark, truth, pred):
    scored = score.score_documents(pairs(spark, [("a", truth, pred, None)]), "receipt", detail=True)
    rows = score.outcome_rows(scored).collect()
    return {r.field: (r.outcome, r.score, r.predicted, r.truth) for r in rows}


def test_outcomes_of_each_kind(spark):
    got = outcomes(
        spark,
        receipt(merchant="EXXON MOBIL CORP", subtotal=1000, tax=1.0, tip=100, transaction_date="2025-10-31",
                line_items=[{"description": "b a", "quantity": 3}], payment_method="visa"),
        receipt(merchant="Exxon Mobil Corporation", subtotal=1004, tax=1.01, tip=102, currency=" usd ",
                merchant_phone="1", line_items=[{"description": "A B", "quantity": 3.0000001}, {"description": "x"}]),
    )
    assert got["merchant"][:2] == ("MISMATCH", 0.821)
    assert got["subtotal"][0] == "TP" and got["tax"][0] == "MISMATCH" and got["tip"][0] == "MISMATCH"
    assert got["transaction_date"] == ("FN", 0.0, "", "2025-10-31")
    assert got["merchant_phone"] == ("FP", 0.0, "1", "")
    assert got["currency"][:2] == ("TP", 1.0) and got["payment_method"][0] == "FN"
    assert got["line_items[]"] == ("MISMATCH", 0.0, "2", "1")
    assert got["line_items[0].description"][:2] == ("TP", 1.0)
    assert got["line_items[0].quantity"][0] == "TP"
    assert got["line_items[1].description"] == ("FP", 0.0, "x", "")
    assert "line_items[1].total" not in got and "merchant_address.line1" not in got
    assert got["total"] == ("TP", 1.0, "10", "10")


def test_truth_dates_are_compared_as_written(spark):
    got = outcomes(spark, receipt(transaction_date="2018-6-25"), receipt(transaction_date="2018-06-25"))
    assert got["transaction_date"][0] == "MISMATCH"


def test_money_scores_keep_the_double_quirks(spark):
    df = spark.createDataFrame(
        [(1.0, 1.01), (72.0, 72.01), (24000.0, 12000.0), (float("nan"), 1.0), (0.0, 0.005)], "p double, t double"
    )
    from fieldledger.functions import compare

    rows = df.select(
        compare.money_match(F.col("p"), F.col("t")), compare.money_score(F.col("p"), F.col("t")).alias("s")
    ).collect()
    assert [r[0] for r in rows] == [False, True, False, False, True]
    assert rows[2].s == 0.0 and rows[3].s == 0.0


CASES = [
    ("same", receipt(), receipt(), None),
    ("wrong", receipt(merchant="alpha beta gamma"), receipt(merchant="alpha beta gamna delta"), None),
    ("failed", receipt(tax=1.0), None, "boom"),
    ("missing", receipt(), None, None),
]


def test_failed_documents_count_as_misses(spark):
    stats = {r.path: r for r in score.field_stats(pairs(spark, CASES), "receipt").collect()}
    assert (stats["total"].tp, stats["total"].fn, stats["total"].support) == (2, 2, 4)
    assert (stats["tax"].fn, stats["tax"].tn) == (1, 2)
    assert stats["line_items[]"].tp == 2 and stats["line_items[]"].fn == 2
    docs = {r.doc_id: r for r in score.doc_stats(pairs(spark, CASES), "receipt").collect()}
    assert docs["same"].exact_match and not docs["failed"].exact_match
    assert docs["failed"].fields_total == 0 and docs["missing"].error == "no prediction"
    run = score.run_summary(score.run_statistics(pairs(spark, CASES), "receipt"), "receipt").first()
    assert (run.n_docs, run.errors, run.label) == (4, 2, "m")
    assert run.mean_latency_ms == 2.0 and run.mean_cost_usd == 0.00045


def test_row_and_compiled_paths_agree(spark):
    p = pairs(spark, CASES)
    rows = score.score_documents(p, "receipt").select("doc_id", F.inline("fields"))
    slow = rows.groupBy("path").agg(*score_counts()).collect()
    fast = score.field_counts(p, "receipt").collect()
    key = lambda rs: sorted((r.path, r.tp, r.fp, r.fn, r.tn) for r in rs)
    assert key(slow) == key(fast)


def score_counts():
    o = F.col("outcome")
    return [
        F.count_if(o == "TP").alias("tp"),
        F.count_if(o.isin("FP", "MISMATCH")).alias("fp"),
        F.count_if(o.isin("FN", "MISMATCH")).alias("fn"),
        F.count_if(o == "TN").alias("tn"),
    ]


def test_swapping_sides_swaps_fp_and_fn(spark):
    a, b = receipt(tax=1.0, merchant="one two"), receipt(tip=2.0, merchant="one three four")
    there = score.field_counts(pairs(spark, [("x", a, b, None)]), "receipt").collect()
    back = score.field_counts(pairs(spark, [("x", b, a, None)]), "receipt").collect()
    assert sorted((r.path, r.tp, r.fp, r.fn) for r in there) == sorted((r.path, r.tp, r.fn, r.fp) for r in back)


def test_partitioning_does_not_matter(spark):
    p = pairs(spark, CASES)
    one = score.field_counts(p.coalesce(1), "receipt").collect()
    many = score.field_counts(p.repartition(8), "receipt").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_macro_ignores_paths_without_support(spark):
    counts = spark.createDataFrame(
        [("a", "text", 1, 0, 0, 0), ("b", "text", 1, 1, 1, 0), ("c", "text", 0, 3, 0, 0)],
        "path string, ftype string, tp long, fp long, fn long, tn long",
    ).select(*[F.lit("r").alias(k) for k in score.RUN], "*")
    r = score.micro_macro(counts).first()
    assert r.macro_f1 == 0.75 and r.tp == 2 and r.fp == 4 and r.micro_recall == 2 / 3


def test_selfcheck_is_perfect(spark):
    truth, _ = frames(spark, [("a", receipt(tax=1.5, line_items=[{"description": "x"}]), None, None)])
    preds = infer.selfcheck_predictions(truth, "receipt")
    p = score.pair_documents(truth, preds, [("selfcheck", None)])
    stats = score.field_stats(p, "receipt").where("support > 0").collect()
    assert stats and all(r.f1 == 1.0 for r in stats)


def test_flatten_paths(spark):
    df = spark.createDataFrame([(receipt(merchant_address={"city": "X"}, line_items=[{"description": "d"}]),)], "t string")
    rec = df.select(F.from_json("t", TRUTH_TYPE).alias("truth"))
    got = {r.path: r for r in flatten.flatten_rows(rec, "truth", RECEIPT, raw=True).collect()}
    assert got["merchant_address.city"].shown == "X" and got["line_items[]"].v_num == 1.0
    assert got["line_items[0].description"].ftype == "text"
    kinds = dict(field_types(get_schema(" Invoice ")))
    assert kinds["line_items[i].tax_rate"] == "number" and kinds["total"] == "money"
    assert kinds["vendor.tax_id"] == "exact" and kinds["invoice_date"] == "date"
    assert dict(field_types(get_schema("filing")))["financials.revenue"] == "number"
    with pytest.raises(KeyError):
        get_schema("memo")


def test_snapshot_pages_hold_every_item_of_a_large_job(spark):
    from pyspark.sql import functions as F

    from fieldledger.operators import jobs

    large = spark.range(5_300).select(
        F.lit("large").alias("job_id"), F.col("id").alias("item"), F.lit("done").alias("status"), F.lit(True).alias("started")
    )
    small = spark.createDataFrame([("small", 7, "pending", False)], large.schema)
    listed = spark.createDataFrame([("large",), ("small",), ("empty",)], "job_id string")
    rows = jobs.job_snapshots(large.union(small), jobs=listed, page_size=1000).orderBy("job_id", "page").collect()
    assert [(r.job_id, r.page, r.status) for r in rows] == [
        ("empty", None, "done"), *(("large", k, "done") for k in range(6)), ("small", 0, "pending"),
    ]
    pages = [[x["index"] for x in r["items"]] for r in rows if r.job_id == "large"]
    assert max(map(len, pages)) == 1000 and sum(pages, []) == list(range(5_300))
    assert {r.progress.total for r in rows if r.job_id == "large"} == {5_300}


def test_document_outcomes_equal_the_nested_ones(spark):
    p = pairs(spark, CASES)
    keys = ["doc_id", "field"]
    nested = score.outcome_rows(score.score_documents(p, "receipt", detail=True)).orderBy(*keys).collect()
    flat = score.document_outcomes(p, "receipt")
    assert flat.orderBy(*keys).collect() == nested
    # Every field is compared once, as a column of a row; no array of outcomes is built per document.
    assert "fields" not in flat._jdf.queryExecution().analyzed().toString()


def test_run_summary_reads_the_documents_once(spark):
    p = pairs(spark, CASES)
    counts = score.run_counts(p, "receipt")
    plan = score.run_summary(score.run_statistics(p, "receipt"), "receipt")._jdf.queryExecution().optimizedPlan().toString()
    alone = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == alone.count("LogicalRDD")
    assert plan.count("Join") == alone.count("Join")
    by_path = {(r.path, r.tp, r.fp, r.fn, r.tn) for r in score.field_rates(counts).collect()}
    assert by_path == {(r.path, r.tp, r.fp, r.fn, r.tn) for r in score.field_counts(p, "receipt").collect()}


def test_counted_blocks_equal_the_fields_one_by_one(spark):
    p = pairs(spark, CASES)
    fields = score.score_documents(p, "receipt").select("error", F.inline("fields"))
    wanted = {}
    for r in fields.collect():
        if r.outcome != "TN" or r.error is None:
            wanted[r.path, r.outcome] = wanted.get((r.path, r.outcome), 0) + 1
    for r in score.field_counts(p, "receipt").collect():
        tp, tn = wanted.get((r.path, "TP"), 0), wanted.get((r.path, "TN"), 0)
        mismatch = wanted.get((r.path, "MISMATCH"), 0)
        assert (r.tp, r.tn) == (tp, tn), r.path
        assert r.fp == wanted.get((r.path, "FP"), 0) + mismatch and r.fn == wanted.get((r.path, "FN"), 0) + mismatch
