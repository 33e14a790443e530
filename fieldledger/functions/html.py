"""HTML to text.

Well-formed pages (by far the most) are handled by a few regular-expression passes in the JVM.
Pages on which those passes could go wrong (unbalanced or nested dropped elements, stray angle
brackets, rare entities) are sent through the standard library's parser in Arrow batches; all
other rows cross as nulls.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldledger.functions.text import WHITESPACE, strip

# Elements whose whole subtree is dropped, elements whose own text does not count
# as page text, elements without an end tag, and the entities decoded in the JVM.
DROPPED = ("script", "style", "nav", "footer", "header")
SILENT = ("rt", "rp", "template")
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&#160;": " ",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&#8217;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&hellip;": "…",
    "&amp;": "&",
}

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_SEAM = "\u0001"
_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""


def _element(name: str) -> str:
    return rf"<{name}\b{_ATTRS}>.*?</{name}\s*>"


_MARKUP = "(?is)<!--.*?-->|" + "|".join(map(_element, DROPPED)) + rf"|<[a-z/!]{_ATTRS}>"
_KNOWN = "|".join(ENTITIES)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _tidy(text: Column) -> Column:
    """Right-trim lines, keep one blank line of a run, trim, end with a newline."""
    lines = F.transform(F.split(text, LINE_BREAK), lambda x: F.rtrim(x, F.lit(WHITESPACE)))
    return F.concat(
        strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")), F.lit("\n")
    )


def with_html_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    page = F.col(html)
    balanced = F.lit(True)
    for name in DROPPED:
        opened = _count(page, rf"(?i)<{name}\b")
        balanced = (
            balanced
            & (opened == _count(page, rf"(?i)</{name}\s*>"))
            & (opened == _count(page, "(?is)" + _element(name)))
        )
    odd = page.rlike(rf"(?i)<!\[|<\?|<(?:{'|'.join(SILENT)})\b") | page.contains(_SEAM)
    stripped = df.withColumn(
        "_bare",
        F.when(balanced & ~odd, F.regexp_replace(page, _MARKUP, _SEAM)),
    )
    bare = F.col("_bare")
    risky = bare.rlike("<[A-Za-z/!?]") | F.regexp_replace(bare, _KNOWN, "").rlike("&[#A-Za-z]")
    decoded = F.regexp_replace(bare, _SEAM + "+", "\n")
    for entity, char in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return (
        stripped.withColumn("_plain", F.when(~risky, decoded))
        .withColumn("_parsed", parse_pages(F.when(F.col("_plain").isNull(), page)))
        .withColumn(out, _tidy(F.coalesce("_plain", "_parsed")))
        .drop("_bare", "_plain", "_parsed")
    )


class _TextNodes(HTMLParser):
    """Collects the text nodes that lie outside dropped subtrees."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[str] = []
        self.run: list[str] = []

    def flush(self) -> None:
        if self.run and not any(x in DROPPED or x in SILENT for x in self.open):
            self.nodes.append("".join(self.run))
        self.run = []

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.flush()
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data.upper().startswith("CDATA["):
            self.run.append(data[6:])
            self.flush()

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = handle_comment


def page_nodes(page: str) -> str:
    parser = _TextNodes()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n".join(parser.nodes)


@F.pandas_udf(T.StringType())
def parse_pages(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else page_nodes(p))


