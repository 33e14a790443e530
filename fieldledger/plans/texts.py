"""Queries over documents and pages: sections, requests, HTML, chat rows, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldledger.functions.html import with_html_text
from fieldledger.functions.similarity import pair_similarities
from fieldledger.functions.text import normalize
from fieldledger.operators import admission, chatrows, infer, sections
from fieldledger.plans.invoices import table
from fieldledger.plans.receipts import choose
from fieldledger.sources.reports import read_chat_rows, write_chat_rows
from fieldledger.sources.storage import new_folder

PROMPTS = {
    "filing": "You read annual filings.",
    "invoice": "You read invoices.",
    "receipt": "You read receipts.",
}


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each document cut in three under item headings, with a contents list."""
    k, t = F.col("doc_id"), F.col("text")
    third = F.floor(F.length(t) / 3).cast("int")
    parts = [
        F.substr(t, F.lit(1), third),
        F.substr(t, third + 1, third),
        F.substr(t, 2 * third + 1),
    ]

    def heading(item: str, title: str) -> Column:
        return choose(
            k,
            F.lit(f"Item {item}. {title}"),
            F.lit(f"  ITEM {item} - {title}"),
            F.lit(f"item {item}: {title}"),
        )

    titles = {"1": "Business", "1A": "Risk Factors", "8": "Financial Statements"}
    contents = F.concat_ws("\n", *[heading(i, n) for i, n in titles.items()])
    no_8 = k % 11 == 0
    blocks = [
        F.concat(F.lit("ANNUAL REPORT\n"), F.col("source"), F.lit("\n")),
        contents,
        F.lit("\nPART I\n"),
        heading("1", "Business"),
        parts[0],
        heading("1A", "Risk Factors"),
        parts[1],
        F.when(no_8, "").otherwise(heading("8", "Financial Statements")),
        parts[2],
    ]
    text = F.when(k % 7 == 0, t).otherwise(F.concat_ws("\n", *blocks))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sections.with_sections(filing_texts(spark, sf_dir))
    return cut.select("doc_id", F.inline_outer("sections")).select(
        "doc_id",
        "item",
        "heading",
        F.col("start").cast("bigint").alias("start_at"),
        F.col("end").cast("bigint").alias("end_at"),
        F.md5("text").alias("digest"),
    )


def sections_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sections.with_sections(filing_texts(spark, sf_dir))
    return cut.select(
        "doc_id",
        F.array_join(sections.item_ids(), ",").alias("items"),
        sections.has_section("1a").alias("has_1a"),
        F.md5(sections.section_text("8", "none")).alias("digest_8"),
        F.length("cover").cast("bigint").alias("cover_chars"),
    )


def filing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sections.filing_requests(filing_texts(spark, sf_dir), PROMPTS)
    user = F.col("messages")[1]["content"]
    return asked.select(
        "doc_id",
        F.col("messages")[0]["content"].alias("system"),
        F.md5(user).alias("digest"),
        F.length(user).cast("bigint").alias("n_chars"),
    )


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = choose(F.col("doc_id"), F.lit("invoice"), F.lit(" Receipt"))
    asked = sections.document_requests(docs.select("doc_id", "text"), kind, PROMPTS)
    return asked.select(
        "doc_id",
        F.col("messages")[0]["content"].alias("system"),
        F.md5(F.col("messages")[1]["content"]).alias("digest"),
    )


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_html_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select(
        "page_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploaded files with names, types and sizes of every kind."""
    k = F.col("page_id")
    name = choose(
        k,
        F.lit("a.pdf"), F.lit("b.TXT"), F.lit("c.exe"), F.lit("noext"), F.lit(".hidden"),
        F.lit("d.tar.png"), F.lit("e.md"), F.lit("f.Jpeg"),
    )
    length = F.when(k % 9 == 0, 11 * 1024 * 1024).when(k % 11 == 0, 0).otherwise(F.length("html"))
    content = F.when(k % 7 == 0, F.concat(F.lit("%PDF"), F.col("html"))).otherwise(
        F.concat(F.lit(" \n"), F.col("html"), F.lit("\t"))
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("in/"), k.cast("string"), F.lit("/"), name).alias("filename"),
        length.cast("bigint").alias("length"),
        choose(
            k, F.lit(" Invoice "), F.lit("receipt"), F.lit("filing"), F.lit("memo"), F.lit("RECEIPT")
        ).alias("doc_type"),
        choose(
            k, F.lit(None), F.lit("application/pdf"), F.lit("text/html"), F.lit("image/png")
        ).cast("string").alias("content_type"),
        F.encode(content, "UTF-8").alias("content"),
    )


def admit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(spark, sf_dir).drop("content")
    refusal, status = admission.verdict()
    _, batch_status = admission.verdict(refuse_empty=False)
    return files.select(
        "page_id", refusal.alias("refusal"), status.alias("status"), batch_status.alias("batch_status")
    )


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = admission.route(page_files(spark, sf_dir))
    return routed.select(
        "page_id", "source_type", F.md5("text").alias("digest"), "page_count"
    )


# --- chat rows ----------------------------------------------------------------------------------


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, ground_truth (JSON text; empty where there is no label)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", _truth().alias("ground_truth"))


def _truth() -> Column:
    record = F.struct("source", "lang", F.lit("Größe").alias("note"), "quality", "toxic")
    return F.when(F.col("quality").isNull(), "{}").otherwise(F.to_json(record))


def ft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chatrows.chat_rows(labelled_documents(spark, sf_dir), "receipt", PROMPTS)

    def content(i: int) -> Column:
        return F.get("messages", F.lit(i))["content"]

    return rows.select(
        "doc_id",
        content(0).alias("system"),
        F.md5(content(1)).alias("user_digest"),
        content(2).alias("assistant"),
        "problem",
    )


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, messages, split of the usable rows. The rows are stored once, so that the passes that
    find the cut read the ids and problems alone; marking shuffles nothing."""
    path = new_folder(spark, "chat-rows")
    rows = chatrows.chat_rows(labelled_documents(spark, sf_dir), "receipt", PROMPTS)
    rows.select("doc_id", "messages", "problem").write.parquet(path)
    return chatrows.split(chatrows.usable(spark.read.parquet(path)), ["doc_id"])


def ft_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split. Texts are judged where they are read, so that none is shuffled."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = docs.select("doc_id", "source", "lang", chatrows.text_problem(F.col("text")).alias("no_text"))
    problem = F.coalesce("no_text", chatrows.truth_problem(_truth()))
    usable = judged.join(labels, "doc_id", "left").where(problem.isNull())
    return chatrows.enough_rows(chatrows.split(usable.select("doc_id"), ["doc_id"]))


def ft_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as written by split and read back, with the number of rows of either split."""
    path = new_folder(spark, "ft")
    write_chat_rows(_split_rows(spark, sf_dir), path)
    back = read_chat_rows(spark, path)
    sizes = [F.count_if(F.col("split") == name).alias(name) for name in ("train", "val")]
    counts = back.agg(F.struct(*sizes)).scalar()

    def content(i: int) -> Column:
        return F.get("messages", F.lit(i))["content"]

    return back.select(
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        content(0).alias("system"),
        F.md5(content(1)).alias("user_digest"),
        content(2).alias("assistant"),
        counts["train"].alias("n_train"),
        counts["val"].alias("n_val"),
    )


# --- similarity ---------------------------------------------------------------------------------


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of every part's label with its neighbour's."""
    part = table(spark, sf_dir, "part")
    label = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    left = part.select("p_partkey", normalize(label).alias("p"))
    right = part.select((F.col("p_partkey") - 1).alias("p_partkey"), normalize(label).alias("t"))
    pairs = left.join(right, "p_partkey")
    score = pair_similarities(F.array(F.struct("p", "t")))
    return pairs.select("p_partkey", F.round(F.get(score, F.lit(0)), 6).alias("similarity"))


# --- inference ----------------------------------------------------------------------------------


def stub_extractor():
    """Deterministic stand-in for a model: some documents are refused."""

    def extract(record: dict) -> dict:
        if record["id"] % 10 == 3:
            raise ValueError("refused")
        n = len(record["text"])
        return {
            "raw": '{"total":%d}' % n,
            "model": "stub",
            "input_tokens": n // 4,
            "output_tokens": 5,
            "latency_ms": float(n % 100),
        }

    return extract


def infer_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return infer.run_extractor(records, stub_extractor, ["id"])
