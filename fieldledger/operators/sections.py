"""Slicing annual filings into numbered items, and assembling extraction requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldledger.functions.text import strip

# The item numbers that count as headings, and the shape of a heading.
ITEM_IDS = (
    "1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "10", "11", "12", "13", "14", "15",
)
HEADING = (
    r"(?iU)(?:^|\n)\s{0,6}item\s+(?:" + "|".join(ITEM_IDS) + r")\b\s*[.\-–—:)]?"
)

SECTION_TYPE = "array<struct<item:string,heading:string,text:string,start:int,end:int>>"


def _kept_headings(ids: Column) -> Column:
    """Positions (1-based) of the last heading of each item, in document order."""
    backwards = F.reverse(ids)
    return F.array_sort(
        F.transform(
            F.array_distinct(ids),
            lambda item: (F.size(ids) + 1 - F.array_position(backwards, item)).cast("int"),
        )
    )


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; None means all."""
    return text if chars is None else F.substr(text, F.lit(1), F.lit(chars))


def length_within(text: Column, chars: int | None) -> Column:
    return F.length(text) if chars is None else F.least(F.length(text), F.lit(chars))


def with_sections(
    df: DataFrame, text: str = "text", cover_chars: int | None = None, heading_chars: int | None = None
) -> DataFrame:
    """Add ``sections`` and ``cover``.

    ``cover_chars`` limits the cover, ``heading_chars`` the heading of a last section that has no
    line break after it; by default neither is cut.

    One scan collects the heading matches, a second one the pieces between them. A section is
    the run of pieces from its last heading to the next kept heading, so its offset is the total
    length of the pieces before it. Everything stays inside the row: no shuffle, no Python.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blank = strip(t) == ""
    cut = df.withColumn("_hits", F.regexp_extract_all(t, F.lit(HEADING), F.lit(0))).withColumn(
        "_gaps", F.split(t, HEADING, -1)
    )
    ids = F.transform(
        "_hits", lambda h: F.upper(F.regexp_extract(h, r"(?iU)item\s+([0-9]+[a-c]?)", 1))
    )
    cut = cut.withColumn("_kept", _kept_headings(ids)).withColumn("_ids", ids)
    hits, gaps, kept = F.col("_hits"), F.col("_gaps"), F.col("_kept")

    def joined(first: Column, count: Column) -> Column:
        """Text of ``count`` pieces (heading and what follows it) from piece ``first`` on."""
        pieces = F.zip_with(
            F.slice(hits, first, count),
            F.slice(gaps, first + 1, count),
            lambda h, g: F.concat(h, g),
        )
        return F.array_join(pieces, "")

    def body(at: Column, i: Column) -> Column:
        last = i == F.size(kept) - 1
        stop = F.when(last, F.size(hits) + 1).otherwise(F.get(kept, i + 1))
        return F.struct(
            F.get(F.col("_ids"), at - 1).alias("item"),
            F.get(hits, at - 1).alias("hit"),
            joined(at, stop - at).alias("full"),
            last.alias("last"),
        )

    cut = cut.withColumn("_raw", F.transform(kept, body)).withColumn(
        "_first", F.length(F.get(gaps, F.lit(0))) + F.when(
            F.size(kept) > 0, F.length(joined(F.lit(1), F.get(kept, F.lit(0)) - 1))
        ).otherwise(0)
    )

    def section(x: Column, i: Column) -> Column:
        before = F.aggregate(
            F.slice(F.col("_raw"), 1, i), F.lit(0), lambda n, y: n + F.length(y["full"])
        )
        start = F.col("_first") + before
        rest = F.substr(x["full"], F.length(x["hit"]) + 1)
        line = F.instr(rest, "\n")
        width = (
            F.when(line > 0, line - 1)
            .when(x["last"], length_within(rest, heading_chars))
            .otherwise(F.length(rest))
        )
        return F.struct(
            x["item"].alias("item"),
            strip(F.concat(x["hit"], F.substr(rest, F.lit(1), width))).alias("heading"),
            F.substr(rest, width + 1).alias("text"),
            start.cast("int").alias("start"),
            (start + F.length(x["full"])).cast("int").alias("end"),
        )

    whole = F.array(
        F.struct(
            F.lit("0").alias("item"),
            F.lit("(no headings)").alias("heading"),
            t.alias("text"),
            F.lit(0).alias("start"),
            F.length(t).alias("end"),
        )
    )
    sections = (
        F.when(blank, F.from_json(F.lit("[]"), SECTION_TYPE))
        .when(F.size(hits) == 0, whole)
        .otherwise(F.transform("_raw", section))
    )
    before = F.when(F.size(hits) == 0, F.length(t)).otherwise(F.col("_first"))
    cover = F.when(blank, "").otherwise(head(F.substr(t, F.lit(1), before), cover_chars))
    return cut.withColumn("sections", sections).withColumn("cover", cover).drop(
        "_hits", "_gaps", "_kept", "_ids", "_raw", "_first"
    )


# --- lookups on the sections array --------------------------------------------------------------


def section(item: str, sections: Column | str = "sections") -> Column:
    """The section with this id (case does not matter), or null."""
    want = item.strip().upper()
    return F.get(F.filter(sections, lambda s: s["item"] == want), F.lit(0))


def section_text(item: str, default: str = "", sections: Column | str = "sections") -> Column:
    return F.coalesce(section(item, sections)["text"], F.lit(default))


def has_section(item: str, sections: Column | str = "sections") -> Column:
    want = item.strip().upper()
    return F.exists(sections, lambda s: s["item"] == want)


def item_ids(sections: Column | str = "sections") -> Column:
    return F.transform(sections, lambda s: s["item"])


# --- requests -----------------------------------------------------------------------------------

# The wording around the document in a request.
ASK = "Extract the structured data from this document. "
WITH_TEXT = "The document text follows (and page images may also be attached):\n\n"
WITHOUT_TEXT = "Only page images are provided (no text was extractable)."
ASK_FILING = (
    "Extract the structured filing data. Three relevant sections of the 10-K are provided below. "
    "Do NOT hallucinate values from other sections not shown.\n\n"
)
BLOCK_LABELS = {
    "cover": "COVER SECTION",
    "8": "FINANCIAL SECTION (Item 8)",
    "1A": "RISK FACTORS SECTION (Item 1A)",
}


def _block(label: str, begin: str, end: str, text: Column) -> Column:
    return F.concat(F.lit(f"---{begin}{label}---\n"), text, F.lit(f"\n---{end}{label}---"))


def document_message(text: Column) -> Column:
    """User message of a plain document."""
    framed = _block("DOCUMENT TEXT", "BEGIN ", "END ", text)
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(ASK + WITH_TEXT), framed)).otherwise(
        ASK + WITHOUT_TEXT
    )


def filing_message(
    cover: Column, sections: Column | str = "sections", item_chars: int | None = None
) -> Column:
    """User message of a filing: cover, Item 8 and Item 1A as labelled blocks.

    ``item_chars`` limits the text of each item; by default it is whole.
    """

    def piece(item: str) -> Column:
        missing = f"(Item {item} not found in this filing.)"
        return head(section_text(item, missing, sections), item_chars)

    blocks = {
        "cover": cover,
        "8": piece("8"),
        "1A": piece("1A"),
    }
    framed = [_block(BLOCK_LABELS[k], "", "END ", v) for k, v in blocks.items()]
    return F.concat(F.lit(ASK_FILING), F.concat_ws("\n\n", *framed))


def chat(system: Column, user: Column, *rest: tuple[str, Column]) -> Column:
    """Array of (role, content) messages."""
    turns = [("system", system), ("user", user), *rest]
    return F.array(
        *[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns]
    )


def prompt_for(doc_type: Column, prompts: dict[str, str]) -> Column:
    """System prompt by document type, from the caller's small prompt table."""
    pairs = [F.lit(x) for kv in sorted(prompts.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(doc_type)))


def filing_requests(
    df: DataFrame,
    prompts: dict[str, str],
    text: str = "text",
    cover_chars: int | None = None,
    item_chars: int | None = None,
) -> DataFrame:
    """Messages for filings; the sections are cut from the whole text first.

    ``cover_chars`` and ``item_chars`` fit the blocks to a model's window; by default all of the
    cover and of both items is sent.
    """
    cut = with_sections(df, text, cover_chars)
    user = filing_message(F.col("cover"), item_chars=item_chars)
    return cut.withColumn("messages", chat(prompt_for(F.lit("filing"), prompts), user)).drop(
        "sections", "cover"
    )


def document_requests(
    df: DataFrame, doc_type: Column, prompts: dict[str, str], text: str = "text"
) -> DataFrame:
    user = document_message(F.col(text))
    return df.withColumn("messages", chat(prompt_for(doc_type, prompts), user))
