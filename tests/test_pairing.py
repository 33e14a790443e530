"""Truth and predictions meet once: same rows as a plain join, and no record moves twice."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import score
from fieldledger.plans import evaluation, invoices, tracking
from fieldledger.sources.storage import bucketed
from fieldledger.streaming import scores

RUNS = [("a", "low"), ("b", None), ("never", None)]
TRUTH = [("x", "1", "t1"), ("x", "2", "t2"), ("x", "2", "t2 again"), ("y", "1", "t3"), ("x", None, "t4"), (None, "1", "t5")]
FOUND = [
    ("a", "low", "x", "1", "p1", None), ("a", "low", "x", "1", "p1 again", None), ("b", None, "x", "1", None, "boom"),
    ("a", None, "x", "2", "other effort", None), ("b", None, "x", "2", "p2", None), ("b", None, "y", "1", "p3", None),
    ("other", None, "y", "1", "other run", None), ("a", "low", "x", None, "no id", None), ("b", None, None, "1", "no set", None),
    ("b", "", "y", "3", "no truth", None),
]


@pytest.fixture
def sides(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    truth = spark.createDataFrame(TRUTH, "dataset string, doc_id string, truth string")
    found = spark.createDataFrame(
        FOUND, "model string, effort string, dataset string, doc_id string, data string, error string"
    ).select("*", F.lit(2.0).alias("latency_ms"), F.lit(1).alias("input_tokens"), F.lit(3).alias("output_tokens"))
    yield truth, found
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def expected():
    for dataset, doc_id, truth in TRUTH:
        for model, effort in RUNS:
            same = [
                p for p in FOUND
                if None not in (dataset, doc_id) and (p[0], p[1] or "", p[2], p[3]) == (model, effort or "", dataset, doc_id)
            ]
            for p in same or [None]:
                error = "no prediction" if p is None else p[5]
                yield model, effort, dataset, doc_id, error, None if error else p[4], truth, None if error else 2.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """The keys of every shuffle of the plan, from the last one to the first."""
    return [re.sub(r"#\d+L?|, \d+$", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?)\), [A-Z]", plan(df))]


@pytest.mark.parametrize("key", [score.DOCUMENT, ("doc_id",)])
def test_pairs_are_those_of_a_plain_join(sides, key):
    rows = score.pair_documents(*sides, RUNS, key)
    shown = rows.select("model", "effort", "dataset", "doc_id", "error", "data", "truth", "latency_ms")
    assert sorted(map(str, map(tuple, shown.collect()))) == sorted(map(str, expected()))


def test_a_truth_record_moves_once_for_all_runs(sides):
    pairs = score.pair_documents(*sides, RUNS)
    assert shuffles(pairs) == ["dataset, doc_id"] * 2
    # The run list is unfolded above the shuffle.
    lines = plan(pairs).splitlines()
    generate = next(k for k, x in enumerate(lines) if "Generate inline" in x)
    assert "Exchange" in "".join(lines[generate + 1 : generate + 3])


def test_sides_that_lie_by_the_key_do_not_move(sides):
    truth, found = sides
    n = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = truth.repartition(n, "doc_id"), found.repartition(n, "doc_id")
    assert shuffles(score.pair_documents(*placed, RUNS, ("doc_id",))) == ["doc_id"] * 2
    kept = bucketed(truth, "truth", "doc_id")
    assert shuffles(score.pair_documents(kept, found, RUNS, ("doc_id",))) == ["doc_id"]
    assert shuffles(scores.arrived(kept, found, ("doc_id",))) == ["doc_id"]
    assert shuffles(scores.unmatched(kept, found, ("doc_id",))) == ["doc_id"]


@pytest.mark.parametrize("key", [score.DOCUMENT, ("doc_id",)])
def test_arrived_and_unmatched_part_the_predictions(sides, key):
    truth, found = sides
    kept = bucketed(truth, "truth", "doc_id")
    assert not truth.sparkSession.catalog.listTables()
    known = {(d, i) for d, i, _ in TRUTH if None not in (d, i)}
    there = sorted(r.data or "" for r in scores.arrived(kept, found, key).collect())
    twice = [p for p in FOUND if (p[2], p[3]) == ("x", "2")]
    assert there == sorted(p[4] or "" for p in [*(p for p in FOUND if (p[2], p[3]) in known), *twice])
    rejects = scores.unmatched(kept, found, key).collect()
    assert sorted(r.data for r in rejects) == ["no id", "no set", "no truth"]


@pytest.fixture
def tables(spark, tmp_path):
    """Orders with two runs of keys, a null key, a double row, an order without lines or customer."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    day = datetime.datetime(2020, 1, 2)
    keys = [*range(60), 7, None]
    rows = {
        "orders": (
            [(k, (k or 0) % 5, "OFP"[(k or 0) % 3], 100.0 + (k or 0), day) for k in keys],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp",
        ),
        "customer": ([(k, f"Customer {k}", k % 2) for k in range(4)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(0, "N"), (1, "M")], "n_nationkey int, n_name string"),
        "part": ([(k, f"blue ring {k}") for k in range(9)] + [(3, "second name")], "p_partkey long, p_name string"),
        "lineitem": (
            [(k, k % 10, n, 1.0 + n, 10.5 * (n + 1), 0.02) for k in range(58) for n in range(k % 4) for _ in range(1 + k % 2)],
            "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double",
        ),
    }
    for name, (content, schema) in rows.items():
        spark.createDataFrame(content, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_invoice_records_are_built_where_they_are_paired(spark, tables):
    pairs = evaluation.invoice_pairs(spark, tables)
    # Lines move by order and line, by part and by document, orders by customer and by document; records never.
    assert not [keys for keys in shuffles(pairs) if "dataset" in keys or "model" in keys]
    assert pairs.count() == 2 * 64  # the double order meets itself in each run that has a prediction
    found = {r.doc_id: r for r in pairs.where("model = 'alpha'").collect()}
    assert found[None].error == "no prediction" and found["59"].truth.line_items == []
    # A part listed under two names gives two lines.
    assert [(x.description, x.quantity) for x in found["3"].truth.line_items[:2]] == [("blue ring 3", 2.0), ("second name", 2.0)]
    assert len(found["3"].truth.line_items) == 6
    assert [x.quantity for x in found["7"].truth.line_items] == [2.0, 4.0, 6.0]


def test_a_stream_of_orders_gives_the_batch_result(spark, tables):
    columns = ["model", "effort", "dataset", "path", "tp", "fp", "fn", "tn"]
    stream = sorted(map(str, tracking.incremental_scores(spark, tables).select(*columns).collect()))
    batch = sorted(map(str, evaluation.eval_field_stats(spark, tables).select(*columns).collect()))
    assert stream == batch
