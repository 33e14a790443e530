"""Derivative records of web captures: linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
RECORD_SCHEMA = (
    "doc_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string,"
    " content_type string, content_length long, block_digest string, header string, block string"
)

_OPENING = re.compile(r"(?i)<!--|<(script|style|template|noscript|head|title)\b[^>]*>")
_CLOSING = {
    name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "template", "noscript", "head", "title")
}
_BLOCK = re.compile(
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|section|article|header|footer|nav|aside|main|pre"
    r"|blockquote|form|figure|figcaption|title|body|html)\b[^>]*>"
)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_HTML = re.compile(r"(?i)<html\b[^>]*>")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z-]+)")


def without_hidden(markup: str) -> str:
    """The markup without comments and elements that are not shown, each up to its nearest closing.
    One pass: once a closing isn't found, it isn't looked for again."""
    out, at, missing = [], 0, set()
    start = _OPENING.search(markup)
    while start:
        name = (start.group(1) or "").lower()
        stop = -1
        if name != "title" and name not in missing:
            closing = _CLOSING[name].search(markup, start.end()) if name else None
            stop = closing.end() if closing else -1 if name else markup.find("-->", start.end()) + 3
            if stop < start.end():
                stop = -1
                missing.add(name)
        if stop >= 0:
            out += [markup[at : start.start()], " "]
            at = stop
        start = _OPENING.search(markup, max(at, start.end()))
    return "".join(out) + markup[at:]


def title_of(markup: str) -> str | None:
    start = next((m for m in _OPENING.finditer(markup) if (m.group(1) or "").lower() == "title"), None)
    stop = start and _CLOSING["title"].search(markup, start.end())
    return markup[start.end() : stop.start()] if stop else None


def plain_text(markup: str) -> str:
    """Readable text: title first, one line per block, without scripts, styles and comments. Linear
    in the markup: behind the last ">" nothing can be a tag."""
    end = markup.rfind(">") + 1
    tags = markup[:end]
    title = title_of(tags)
    body = _TAG.sub("", _BLOCK.sub("\n", without_hidden(tags))) + markup[end:]
    if title is not None:
        body = _TAG.sub("", title) + "\n" + body
    body = entities.unescape(body)
    lines = (_BLANKS.sub(" ", line).strip() for line in body.split("\n"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def language_of(markup: str) -> str | None:
    """The lang attribute of the first html tag that has one."""
    tags = (_LANG.search(m.group()) for m in _HTML.finditer(markup[: markup.rfind(">") + 1]))
    return next((m.group(1).lower() for m in tags if m), None)


def record_id(*parts: str) -> str:
    """A urn that depends on the parts alone, so that a task run again makes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def header(fields: Iterable[tuple[str, str | None]]) -> str:
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None)]
    return "\r\n".join(lines) + "\r\n\r\n"


def derive(row) -> Iterator[tuple]:
    """The metadata and the conversion record of one response."""
    uri, source = row.target_uri or "", row.record_id
    payload = (row.payload or "").encode()
    source_digest = digest(payload)
    text = plain_text(row.payload or "")
    named = source or f"{uri}{chr(31)}{row.warc_date or ''}{chr(31)}{source_digest}"
    conversion = record_id(named, "conversion")
    lang = language_of(row.payload or "")
    facts = [
        ("source-payload-digest", source_digest),
        ("source-payload-length", str(len(payload))),
        ("conversion-record", conversion),
        ("language", lang),
    ]
    for line in (row.http_headers or "").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            facts.append((f"source-header-{name.strip().lower()}", value.strip()))
        elif line.strip():
            facts.append(("source-status-line", line.strip()))
    fields = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in facts if v is not None)
    for kind, own, content_type, block in (
        ("metadata", record_id(named, "metadata"), "application/warc-fields", fields),
        ("conversion", conversion, "text/plain; charset=UTF-8", text),
    ):
        data = block.encode()
        block_digest = digest(data)
        head = header(
            (
                ("WARC-Type", kind),
                ("WARC-Record-ID", own),
                ("WARC-Refers-To", source),
                ("WARC-Refers-To-Target-URI", uri),
                ("WARC-Refers-To-Date", row.warc_date),
                ("WARC-Target-URI", uri),
                ("WARC-Date", row.warc_date),
                ("WARC-Source-Payload-Digest", source_digest),
                ("WARC-Block-Digest", block_digest),
                ("Content-Type", content_type),
                ("Content-Length", str(len(data))),
            )
        )
        yield (row.doc_id, kind, own, source, uri, row.warc_date, content_type, len(data), block_digest, head, block)


def _derive_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for start in range(0, len(batch), 500):
            part = batch.iloc[start : start + 500].astype(object)
            part = part.where(part.notna(), None)
            yield pd.DataFrame([r for row in part.itertuples(index=False) for r in derive(row)], columns=names)


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response: metadata, then conversion.

    ``responses``: doc_id, record_id, target_uri, warc_date, http_headers (CRLF lines), payload
    (decoded markup). Both records point to the response by id, URI and date and carry its payload
    digest; the metadata record names the conversion and repeats the response's HTTP headers.
    header + block is the record as it stands in a file. A null payload is an empty one, a null
    URI is empty, null headers give none. A response without id has no refers-to; its records are
    then named by its URI, date and payload digest. Row by row; nothing is shuffled.
    """
    columns = ["doc_id", "record_id", "target_uri", "warc_date", "http_headers", "payload"]
    return responses.select(*columns).mapInPandas(_derive_batches, RECORD_SCHEMA)


def page_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html), which carry no headers or date of
    their own: the date is a parameter and the headers state type and length."""
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    name = F.sha2(
        F.concat_ws("\u001f", F.col("page_id").cast("string"), F.col("url"), F.coalesce("html", F.lit(""))).cast("binary"), 256
    )
    group = lambda start, size: F.substring(name, start, size)
    return pages.select(
        F.col("page_id").cast("long").alias("doc_id"),
        F.concat(
            F.lit("<urn:uuid:"), group(1, 8), F.lit("-"), group(9, 4), F.lit("-8"), group(14, 3), F.lit("-8"),
            group(18, 3), F.lit("-"), group(21, 12), F.lit(">"),
        ).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), length
        ).alias("http_headers"),
        F.col("html").alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one per partition; each ends with the two line breaks that
    part records."""
    lines = records.select(F.concat("header", "block").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").text(path)
