"""Which files are accepted for extraction, and how their content is routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.text import doc_type_key, strip
from fieldledger.schemas import doc_type_names

# Limits, accepted extensions and MIME types, and the codes of each refusal.
MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif", ".txt")
MIME_TYPES = (
    "application/pdf", "image/png", "image/jpeg", "image/jpg", "image/webp", "image/bmp", "image/tiff",
    "application/octet-stream", "text/plain",
)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif")
TEXT_EXTENSIONS = (".txt", ".text", ".md", ".log")
REFUSALS = {
    "unsupported_doc_type": 400,
    "unsupported_media_type": 415,
    "empty_document": 422,
    "file_too_large": 413,
}


def suffix(filename: Column) -> Column:
    """Lower-case extension with its dot; empty for dot-files and names without one."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.lower(F.regexp_extract(base, r"[^.]\.*(\.[^.]+)$", 1))


def verdict(
    filename: str = "filename",
    length: str = "length",
    doc_type: str = "doc_type",
    content_type: str = "content_type",
    refuse_empty: bool = True,
    max_bytes: int | None = MAX_BYTES,
) -> tuple[Column, Column]:
    """``refusal`` and ``status``: null and 200 when the file may be extracted.

    Only metadata is looked at, so the file content is never read. Batches skip the check for
    empty files (``refuse_empty=False``); ``max_bytes=None`` accepts files of any size.
    """
    mime = F.coalesce(F.col(content_type), F.lit(""))
    checks = [
        ("unsupported_doc_type", ~doc_type_key(F.col(doc_type)).isin(doc_type_names())),
        ("unsupported_media_type", ~suffix(F.col(filename)).isin(*EXTENSIONS)),
        ("unsupported_media_type", (mime != "") & ~mime.isin(*MIME_TYPES)),
    ]
    if refuse_empty:
        checks.append(("empty_document", F.col(length) == 0))
    if max_bytes is not None:
        checks.append(("file_too_large", F.col(length) > max_bytes))
    refusal, status = F.lit(None).cast("string"), F.lit(200)
    for code, refused in reversed(checks):
        failed = F.coalesce(refused, F.lit(True))
        refusal = F.when(failed, code).otherwise(refusal)
        status = F.when(failed, REFUSALS[code]).otherwise(status)
    return refusal, status


def admit(df: DataFrame, **options) -> DataFrame:
    """Add ``refusal`` and ``status``; the options are those of ``verdict``."""
    refusal, status = verdict(**options)
    return df.select("*", refusal.alias("refusal"), status.alias("status"))


def route(df: DataFrame, filename: str = "filename", content: str = "content") -> DataFrame:
    """Add ``source_type``, ``text`` and ``page_count``.

    Text files are decoded (bad bytes are replaced) and stripped; images and PDFs are only
    recognised, decoding them is left to the extractor.
    """
    ext = suffix(F.col(filename))
    magic = F.substring(F.col(content), 1, 4) == F.lit(b"%PDF")
    # No built-in decodes leniently under ANSI mode, except this one.
    decoded = strip(F.make_valid_utf8(F.col(content).cast("string")))
    source_type = (
        F.when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when((ext == ".pdf") | magic, "pdf")
        .when(ext.isin(*TEXT_EXTENSIONS) & (decoded != ""), "text")
        .otherwise("empty")
    )
    typed = df.withColumn("source_type", source_type)
    is_text = F.col("source_type") == "text"
    pages = F.when(is_text | (F.col("source_type") == "image"), 1).when(
        F.col("source_type") == "empty", 0
    )
    return typed.withColumn("text", F.when(is_text, decoded).otherwise("")).withColumn(
        "page_count", pages
    )
