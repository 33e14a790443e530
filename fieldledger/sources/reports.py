"""Report writers and readers. Every run of a benchmark is written by one job."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.labels import report_tag, run_label
from fieldledger.functions.numbers import round_exact
from fieldledger.operators import report, rollup, score
from fieldledger.operators.score import RUN

SUMMARY_TYPE = (
    "generated_at string, summary struct<model:string,effort:string,dataset:string,label:string,"
    "doc_type:string,n_docs:bigint,errors:bigint,micro_f1:double,macro_f1:double,"
    "doc_exact_match:double,mean_latency_ms:double,mean_cost_usd:double,total_cost_usd:double>"
)


def _tag(doc_type: str) -> Column:
    label = run_label(F.col("model"), F.col("effort"))
    tag = report_tag(F.lit(doc_type), label)
    return F.concat_ws("_", tag, "dataset").alias("tag")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def write_per_record(outcomes: DataFrame, doc_type: str, path: str) -> None:
    """One CSV row per (document, field), in a folder per run."""
    columns = [c for c in outcomes.columns if c not in RUN]
    (
        outcomes.select(_tag(doc_type), *columns)
        .write.mode("overwrite")
        .partitionBy("tag")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def summary_documents(summary: DataFrame, stats: DataFrame, generated_at: str) -> DataFrame:
    """One nested row per run: generated_at, summary, aggregate, field_stats by path."""
    numbers = ["tp", "fp", "fn", "tn", "support", "precision", "recall", "f1"]
    rounded = [round_exact(F.col(c), 4).alias(c) if c in numbers[5:] else F.col(c) for c in numbers]
    entry = F.struct(F.col("path").alias("field"), F.col("ftype").alias("field_type"), *rounded)
    per_run = stats.groupBy(*RUN).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", entry)))).alias("field_stats")
    )
    pooled = score.micro_macro(stats)
    aggregate = F.struct(
        *[round_exact(F.col(c), 4).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")]
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in RUN]
    same_a = [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in RUN]
    return (
        summary.select(*RUN, F.struct("*").alias("summary"))
        .alias("s")
        .join(per_run.alias("f"), same, "left")
        .join(pooled.select(*RUN, aggregate.alias("aggregate")).alias("a"), same_a, "left")
        .select(
            *[F.col(f"s.{c}") for c in RUN],
            F.lit(generated_at).alias("generated_at"),
            "summary",
            "aggregate",
            "field_stats",
        )
    )


def write_summary(
    summary: DataFrame, stats: DataFrame, doc_type: str, path: str, generated_at: str | None = None
) -> None:
    docs = summary_documents(summary, stats, generated_at or _now())
    (
        docs.select(_tag(doc_type), "generated_at", "summary", "aggregate", "field_stats")
        .write.mode("overwrite")
        .partitionBy("tag")
        .json(path)
    )


def markdown_lines(
    summary: DataFrame, stats: DataFrame, docs: DataFrame, generated_at: str
) -> DataFrame:
    """Every line of every report with its sort keys: section, a, b, c."""
    none = F.lit(None).cast("double")
    text = F.lit(None).cast("string")

    def part(df: DataFrame, section: int, a: Column, b: Column, c: Column) -> DataFrame:
        return df.select(
            *RUN,
            F.lit(section).alias("section"),
            a.cast("double").alias("a"),
            b.cast("double").alias("b"),
            c.alias("c"),
            "line",
        )

    def fixed(section: int, *lines: str, only: DataFrame = summary) -> DataFrame:
        listed = only.select(*RUN, F.posexplode(F.array(*map(F.lit, lines))).alias("pos", "line"))
        return part(listed, section, F.col("pos"), none, text)

    fields = report.field_lines(stats)
    parts = [
        part(report.headline_lines(summary), 0, F.col("pos"), none, text),
        fixed(1, "", f"_Generated: {generated_at}_", "", "## Per-field performance", "",
              "| Field | Type | Support | Precision | Recall | F1 |", "|---|---|---:|---:|---:|---:|"),
        part(fields, 2, -F.col("support"), -F.col("f1_exact"), F.col("field")),
        fixed(3, "", "## Errors", "", only=summary.where("errors > 0")),
        part(report.error_lines(docs), 4, none, none, F.col("doc_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(
    summary: DataFrame,
    stats: DataFrame,
    docs: DataFrame,
    doc_type: str,
    path: str,
    generated_at: str | None = None,
) -> None:
    """Reports as text. A total sort (not one task) puts the lines in order, because the error
    list can be as long as the run."""
    lines = markdown_lines(summary, stats, docs, generated_at or _now())
    (
        lines.withColumn("tag", _tag(doc_type))
        .orderBy("tag", "section", "a", "b", "c")
        .select("tag", "line")
        .write.mode("overwrite")
        .partitionBy("tag")
        .text(path)
    )


def write_reports(pairs: DataFrame, doc_type: str, path: str) -> dict[str, str]:
    """All three reports of every run. ``pairs`` (with cost) is read several times, so give a
    persisted or stored table when it is expensive."""
    stats = score.field_stats(pairs, doc_type)
    summary = score.run_summary(score.run_statistics(pairs, doc_type), doc_type)
    outcomes = score.document_outcomes(pairs, doc_type)
    out = {k: f"{path}/{k}" for k in ("per_record", "summary", "markdown")}
    stamp = _now()
    write_per_record(outcomes, doc_type, out["per_record"])
    write_summary(summary, stats, doc_type, out["summary"], stamp)
    docs = pairs.select(*RUN, "doc_id", "error")
    write_markdown(summary, stats, docs, doc_type, out["markdown"], stamp)
    return out


def read_latest_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary (by file name) in each run folder."""
    rows = spark.read.schema(SUMMARY_TYPE).json(path, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("folder"),
        F.col("_metadata.file_name").alias("file"),
        "summary",
    )
    newest = rows.groupBy("folder").agg(F.max_by("summary", "file").alias("summary"))
    return newest.select("summary.*")


def write_comparison(compared: DataFrame, path: str) -> dict[str, str]:
    """Comparison table as json, csv and markdown; one row per declared model."""
    out = {k: f"{path}/comparison_{k}" for k in ("json", "csv", "md")}
    ordered = compared.orderBy("pos").coalesce(1)
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(out["json"])
    plain = rollup.csv_rows(compared).orderBy("pos").coalesce(1).drop("pos")
    plain.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(out["csv"])
    head = [
        "# Multi-model benchmark",
        "",
        "| Model | Effort | Micro F1 | Macro F1 | Doc-exact | Latency (ms) | Cost / doc | Total cost |",
        "|---|---|---:|---:|---:|---:|---:|---:|",
    ]
    spark = compared.sparkSession
    top = spark.range(1).select(F.posexplode(F.array(*map(F.lit, head))).alias("pos", "line"))
    lines = top.withColumn("pos", F.col("pos") - len(head)).unionByName(rollup.markdown_rows(compared))
    lines.orderBy("pos").coalesce(1).select("line").write.mode("overwrite").text(out["md"])
    return out


def write_chat_rows(rows: DataFrame, path: str) -> None:
    """``messages`` as JSON lines, in one folder per split."""
    rows.select("split", "messages").write.mode("overwrite").partitionBy("split").json(path)


def read_chat_rows(spark: SparkSession, path: str) -> DataFrame:
    """messages, split of all rows that ``write_chat_rows`` left; a split without rows has no folder."""
    schema = "messages array<struct<role: string, content: string>>, split string"
    return spark.read.schema(schema).json(path, mode="FAILFAST")
