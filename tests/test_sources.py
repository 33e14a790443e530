import json
import os

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import chatrows, infer, jobs, rollup, score
from fieldledger.schemas import RECEIPT, struct_type
from fieldledger.sources import documents, jsonl, reports
from fieldledger.streaming import progress, stages
from tests.test_scoring import CASES, pairs, receipt


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_jsonl_round_trip(spark, tmp_path):
    rows = [("a", "é", receipt(tax=1.5)), ("b", "s", receipt())]
    df = spark.createDataFrame(rows, "id string, source string, t string").select(
        "id", "source", F.from_json("t", struct_type(RECEIPT, raw=True)).alias("ground_truth")
    )
    out = str(tmp_path / "out")
    assert jsonl.write_jsonl(df, out) == 2
    text = "".join(r.value for r in spark.read.text(out).collect())
    assert '"tax":null' in text and "é" in text
    back = {r.id: r for r in jsonl.read_truth(spark, out, "receipt").collect()}
    assert back["a"].ground_truth.tax == 1.5 and back["b"].ground_truth.tip is None


def test_malformed_lines_fail(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", '{"id":"a"}\n\n{bad\n')
    with pytest.raises(Exception):
        jsonl.read_truth(spark, path, "receipt").collect()


def test_positions_count_over_files(spark, tmp_path):
    put(tmp_path, "b.txt", "\n".join(f"b{i}" for i in range(5)))
    put(tmp_path, "a.txt", "\n".join(["x" * 300] * 3 + ["", "last"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = sorted((r.pos, r.raw[:4]) for r in jsonl.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(0, "xxxx"), (1, "xxxx"), (2, "xxxx"), (4, "last")] + [(5 + i, f"b{i}") for i in range(5)]


def test_split_fallback(spark, tmp_path):
    put(tmp_path, "test.jsonl", '{"id":"a"}\n')
    got = jsonl.load_split(spark, "test", [str(tmp_path / "none"), str(tmp_path)])
    assert [r.id for r in got.collect()] == ["a"]
    with pytest.raises(FileNotFoundError):
        jsonl.load_split(spark, "test", [str(tmp_path / "none")])


def test_bundles_and_feeds(spark, tmp_path):
    put(tmp_path, "A_1_10k.txt", "Item 1\nbody\n")
    put(tmp_path, "A_1_10k.meta.json", json.dumps({"ticker": "A", "cik10": "1", "form": "10-K"}, indent=2))
    put(tmp_path, "A_1_10k.facts.json", json.dumps({"facts": {"us-gaap": {}}}))
    put(tmp_path, "B_1_10k.txt", "no sidecar")
    texts, notes, facts = documents.read_bundles(spark, str(tmp_path))
    assert sorted(r.stem for r in texts.collect()) == ["A_1_10k", "B_1_10k"]
    assert texts.join(notes, "stem").join(facts, "stem", "left").first().ticker == "A"
    path = put(tmp_path, "tickers.json", json.dumps({"0": {"ticker": "aapl", "cik_str": 320193}}))
    assert documents.read_ticker_file(spark, path).first() == ("AAPL", "0000320193")
    feed = {"name": "N", "exchanges": ["Nasdaq"], "stateOfIncorporation": "", "filings": {"recent": {
        "form": ["8-K", "10-K/A", "10-K", "10-K"], "accessionNumber": list("wxyz"), "filingDate": list("1234"),
        "reportDate": list("abcd"), "primaryDocument": list("efgh")}}}
    path = put(tmp_path, "CIK0000000007.json", json.dumps(feed))
    from fieldledger.operators import filings

    rows = filings.explode_submissions(documents.read_submissions(spark, path))
    newest = filings.latest_annual(rows, "cik10").first()
    assert (newest.cik10, newest.accession, newest.exchange, newest.state_of_incorporation) == (
        "0000000007", "y", "Nasdaq", None)


def test_reports(spark, tmp_path):
    out = reports.write_reports(pairs(spark, CASES).persist(), "receipt", str(tmp_path / "r"))
    rows = spark.read.option("header", True).csv(out["per_record"]).collect()
    failed = [r for r in rows if r.field == "__error__"]
    assert len(failed) == 2 and failed[0].score == "0.0" and failed[0].latency_ms is None
    assert all(r.outcome != "TN" for r in rows) and rows[0].tag == "receipt_m_d"
    (s,) = reports.read_latest_summaries(spark, out["summary"]).collect()
    assert (s.n_docs, s.errors, s.label) == (4, 2, "m")
    lines = [r.value for r in spark.read.text(out["markdown"]).collect()]
    table = [x for x in lines if x.startswith("| `")]
    assert lines[0] == "# Evaluation Report — `receipt` on `m`" and len(table) == 5
    assert table == sorted(table, key=lambda x: (-int(x.split("|")[3]), -float(x.split("|")[6]), x))
    assert "- `failed`: boom" in lines


def test_comparison(spark, tmp_path):
    stats = score.run_statistics(pairs(spark, CASES), "receipt")
    rolled = rollup.weighted_rollup(score.run_summary(stats, "receipt"))
    compared = rollup.comparison(rollup.declared_combos(spark, ["m", "x:low"]), rolled)
    out = reports.write_comparison(compared, str(tmp_path / "c"))
    lines = [r.value for r in spark.read.text(out["md"]).collect()]
    assert lines[-1] == "| `x` | low | — | — | — | — | — | — |" and lines[-2].startswith("| `m` | — | 0.")
    rows = spark.read.option("header", True).csv(out["csv"]).collect()
    assert [r.model for r in rows] == ["m", "x"] and rows[1].micro_f1 is None


def test_extractor_isolates_failures_and_retries(spark):
    def make():
        seen = {}

        def extract(record):
            seen[record["id"]] = seen.get(record["id"], 0) + 1
            if record["id"] == 1:
                raise ValueError("refused")
            if record["id"] == 2 and seen[2] < 3:
                raise infer.Retryable("busy")
            return {"raw": f"{seen[record['id']]}", "model": "m", "input_tokens": 1}

        return extract

    calls = []
    flaky = make()
    assert infer.call_with_retry(flaky, {"id": 2}, pause=calls.append)["raw"] == "3" and calls == [1.0, 2.0]
    tried = []

    def busy(record):
        tried.append(record)
        raise infer.Retryable("busy")

    with pytest.raises(infer.Retryable):
        infer.call_with_retry(busy, {"id": 9}, pause=lambda _: None)
    assert len(tried) == 3
    rows = spark.range(2).select("id")
    got = {r.id: r for r in infer.run_extractor(rows, make, ["id"]).collect()}
    assert got[0].raw == "1" and got[0].latency_ms is not None and got[1].error == "refused"


def test_document_resolution(spark, tmp_path):
    path = put(tmp_path, "d.txt", "from file")
    rows = spark.createDataFrame([("a", path, None), ("b", "/no/file", "t"), ("c", None, "inline"), ("d", None, "")],
                                 "id string, file_path string, text string")
    files = documents.read_documents(spark, str(tmp_path)).select("path", "content")
    got = {r.id: r for r in infer.resolve_documents(rows, files).collect()}
    assert bytes(got["a"].content) == b"from file" and got["a"].filename == "d.txt" and got["a"].error is None
    assert got["b"].error.startswith("file_path not found")
    assert got["c"].filename == "c.txt" and bytes(got["c"].content) == b"inline" and got["d"].error


EVENTS = [(1, 0, 1, "pending"), (1, 1, 2, "pending"), (1, 0, 3, "running"), (1, 0, 4, "done"), (2, 0, 5, "pending"),
          (3, 0, 6, "error"), (1, 1, 7, "running")]


def test_progress_stream_over_batches(spark, tmp_path):
    schema = "job_id long, item long, seq long, status string"
    src = str(tmp_path / "src")
    for i in range(0, len(EVENTS), 2):
        spark.createDataFrame(EVENTS[i : i + 2], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = str(tmp_path / "log")
    progress.start_progress_log(stream, log, str(tmp_path / "cp")).awaitTermination()
    batch = jobs.job_progress(jobs.latest_items(spark.createDataFrame(EVENTS, schema)))
    got = sorted(map(tuple, progress.read_progress(spark, log).collect()))
    assert got == sorted(map(tuple, batch.collect()))
    assert [g[-1] for g in got] == ["running", "pending", "done"]
    everyone = spark.createDataFrame([(1,), (9,)], "job_id long")
    empty = jobs.job_progress(jobs.latest_items(spark.createDataFrame(EVENTS, schema)), everyone)
    assert {r.job_id: r.status for r in empty.collect()}[9] == "done"


def test_stage_stream_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    parts = [
        [(1, "starting", 0), (2, "starting", 1), (1, "done", 9)],  # done before loading
        [(1, "loading", 2), (3, "starting", 3), (1, "loading", 4)],
        [(2, "error", 5), (2, "done", 6)],
    ]
    for p in parts:
        df = spark.createDataFrame(p, "request_id long, stage string, s long")
        df = df.select("request_id", "stage", F.timestamp_seconds(F.col("s") + 1700000000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = str(tmp_path / "log")
    stages.start_stage_log(stream, log, str(tmp_path / "cp")).awaitTermination()
    batch = sorted(map(tuple, jobs.stage_timing(spark.read.parquet(src)).collect()), key=str)
    for place in (log, str(tmp_path / "small")):
        rows = stages.read_stage_timing(spark, place).collect()
        assert sorted(map(tuple, rows), key=str) == batch
        got = {r.request_id: r for r in rows}
        assert (got[1].loading_ms, got[1].done_ms, got[1].outcome) == (2000, 9000, "ok")
        assert (got[2].error_ms, got[2].outcome) == (4000, "error") and got[3].outcome == "open"
        if place == log:
            stages.compact_stage_log(spark, log, str(tmp_path / "small"))


def test_chat_rows_written_by_split(spark, tmp_path):
    """Null and empty texts and empty truth are set aside; both splits come back; an empty one has no folder."""
    rows = [(i, f"text {i}\n\"é\"", '{"a":1}') for i in range(20)]
    odd = [(20, None, '{"a":1}'), (21, "", '{"a":1}'), (22, "x", "{}"), (23, "x", None), (24, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id int, text string, ground_truth string")
    made = chatrows.chat_rows(df, "receipt", {"receipt": "Read."}).select("doc_id", "messages", "problem")
    problems = {r.doc_id: r.problem for r in chatrows.skipped(made, "doc_id").collect()}
    assert problems == {20: "no_text", 21: "no_text", 22: "empty_ground_truth", 23: "empty_ground_truth", 24: "no_text"}
    marked = chatrows.split(chatrows.usable(made), ["doc_id"])
    reports.write_chat_rows(marked, str(tmp_path / "both"))
    back = reports.read_chat_rows(spark, str(tmp_path / "both")).collect()
    wanted = {(r.split, tuple(m.content for m in r.messages)) for r in marked.collect()}
    assert len(back) == 20 and {(r.split, tuple(m.content for m in r.messages)) for r in back} == wanted
    assert sum(r.split == "val" for r in back) == 4
    reports.write_chat_rows(chatrows.split(chatrows.usable(made), ["doc_id"], fraction=0), str(tmp_path / "one"))
    assert [p.name for p in (tmp_path / "one").glob("split=*")] == ["split=train"]
    reports.write_chat_rows(marked.limit(0), str(tmp_path / "none"))
    assert reports.read_chat_rows(spark, str(tmp_path / "none")).count() == 0


def test_facts_first_unit_shuffles_once(spark):
    from fieldledger.plans import benchmarks

    plan = benchmarks.facts_first_unit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
