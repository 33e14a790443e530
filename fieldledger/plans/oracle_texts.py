"""DuckDB statements for the document and page queries."""

from __future__ import annotations

from fieldledger.plans.oracle_prep import _choose
from fieldledger.plans.oracle_similarity import similarity_ctes

# Longer ids first, since this engine takes the first alternative that fits.
_IDS = "1A|1B|1C|1|2|3|4|5|6|7A|7|8|9A|9B|9|10|11|12|13|14|15"
_HEADING = f"(?i)(?:^|\\n)\\s{{0,6}}item\\s+(?:{_IDS})\\b\\s*[.\\-–—:)]?"


def _title(item: str, title: str) -> str:
    return _choose(
        "doc_id",
        f"'Item {item}. {title}'",
        f"'  ITEM {item} - {title}'",
        f"'item {item}: {title}'",
    )


_T1, _T1A, _T8 = (
    _title("1", "Business"),
    _title("1A", "Risk Factors"),
    _title("8", "Financial Statements"),
)

_FILINGS = f"""
WITH filings AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text ELSE concat_ws(chr(10),
      'ANNUAL REPORT' || chr(10) || source || chr(10),
      concat_ws(chr(10), {_T1}, {_T1A}, {_T8}),
      chr(10) || 'PART I' || chr(10),
      {_T1}, substring(text, 1, n), {_T1A}, substring(text, n + 1, n),
      CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_T8} END, substring(text, 2 * n + 1)) END AS t
  FROM (SELECT *, length(text) // 3 AS n FROM documents)),
hits AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_HEADING}') AS h,
         string_split_regex(t, '{_HEADING}') AS g
  FROM filings),
placed AS (
  SELECT doc_id, t, i, h[i] AS hit,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM hits, unnest(range(1, len(h) + 1)) AS u(i)),
named AS (
  SELECT *, upper(regexp_extract(hit, '(?i)item\\s+([0-9]+[a-c]?)', 1)) AS item FROM placed),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY s DESC) AS rn FROM named),
bounds AS (
  SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM kept WHERE rn = 1),
cut AS (
  SELECT doc_id, item, hit, s, coalesce(nxt, length(t)) AS e, nxt IS NULL AS last,
         substring(t, CAST(s + length(hit) + 1 AS BIGINT),
                   CAST(coalesce(nxt, length(t)) - s - length(hit) AS BIGINT)) AS rest
  FROM bounds),
lined AS (
  SELECT *, CASE WHEN position(chr(10) IN rest) > 0 THEN position(chr(10) IN rest) - 1
                 ELSE length(rest) END AS w
  FROM cut),
sections AS (
  SELECT doc_id, item, trim(hit || substring(rest, 1, w), chr(10) || ' ') AS heading,
         CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at,
         substring(rest, w + 1) AS body
  FROM lined
  UNION ALL
  SELECT doc_id, '0', '(no headings)', 0, length(t), t FROM hits WHERE len(h) = 0),
covers AS (
  SELECT doc_id, substring(t, 1, CAST(coalesce(m, length(t)) AS BIGINT)) AS c6,
         coalesce(m, length(t)) AS c4
  FROM filings LEFT JOIN
       (SELECT doc_id, min(s) AS m FROM bounds GROUP BY doc_id) USING (doc_id)),
texts AS (
  SELECT f.doc_id, c6, c4,
    coalesce((SELECT body FROM sections x WHERE x.doc_id = f.doc_id AND item = '8'),
             '(Item 8 not found in this filing.)') AS i8,
    coalesce((SELECT body FROM sections x WHERE x.doc_id = f.doc_id AND item = '1A'),
             '(Item 1A not found in this filing.)') AS i1a
  FROM filings f JOIN covers USING (doc_id))
"""

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


_FILING_MESSAGE = (
    "'Extract the structured filing data. Three relevant sections of the 10-K are provided "
    "below. Do NOT hallucinate values from other sections not shown.' || chr(10) || chr(10) || "
    + _lines(
        "'---COVER SECTION---'", "c6", "'---END COVER SECTION---'", "''",
        "'---FINANCIAL SECTION (Item 8)---'", "i8",
        "'---END FINANCIAL SECTION (Item 8)---'", "''",
        "'---RISK FACTORS SECTION (Item 1A)---'", "i1a",
        "'---END RISK FACTORS SECTION (Item 1A)---'",
    )
)


def _document_message(text: str) -> str:
    framed = _lines(
        "'Extract the structured data from this document. The document text follows (and page "
        "images may also be attached):'",
        "''",
        "'---BEGIN DOCUMENT TEXT---'",
        text,
        "'---END DOCUMENT TEXT---'",
    )
    return (
        f"CASE WHEN coalesce({text}, '') <> '' THEN {framed} ELSE 'Extract the structured data "
        "from this document. Only page images are provided (no text was extractable).' END"
    )


_DROPPED = "script|style|nav|footer|header"
_MARKUP = (
    "(?is)<!--.*?-->|"
    + "|".join(f"<{n}\\b[^>]*>.*?</{n}\\s*>" for n in _DROPPED.split("|"))
    + "|<[a-z/!][^>]*>"
)

_FILES = f"""
WITH files AS (
  SELECT page_id, {_choose('page_id', "'a.pdf'", "'b.TXT'", "'c.exe'", "'noext'", "'.hidden'",
                           "'d.tar.png'", "'e.md'", "'f.Jpeg'")} AS filename,
         {_choose('page_id', "'.pdf'", "'.txt'", "'.exe'", "''", "''", "'.png'", "'.md'",
                  "'.jpeg'")} AS ext,
         CASE WHEN page_id % 9 = 0 THEN 11534336 WHEN page_id % 11 = 0 THEN 0
              ELSE length(html) END AS size,
         {_choose('page_id', "'invoice'", "'receipt'", "'filing'", "'memo'", "'receipt'")} AS kind,
         {_choose('page_id', "NULL", "'application/pdf'", "'text/html'", "'image/png'")} AS mime,
         page_id % 7 = 0 AS is_pdf, html
  FROM pages)
"""

_REFUSAL = """CASE WHEN kind = 'memo' THEN 'unsupported_doc_type'
  WHEN ext NOT IN ('.pdf', '.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tiff', '.tif', '.txt')
    OR mime = 'text/html' THEN 'unsupported_media_type'
  {empty} WHEN size > 10485760 THEN 'file_too_large' END"""
_STATUS = """CASE {r} WHEN 'unsupported_doc_type' THEN 400 WHEN 'unsupported_media_type' THEN 415
  WHEN 'empty_document' THEN 422 WHEN 'file_too_large' THEN 413 ELSE 200 END"""
_EMPTY = "WHEN size = 0 THEN 'empty_document'"

_LABELLED = """
WITH docs AS (
  SELECT d.doc_id, d.text, d.source, d.lang, quality, toxic,
         CASE WHEN coalesce(d.text, '') = '' THEN 'no_text'
              WHEN quality IS NULL THEN 'empty_ground_truth' END AS problem
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

_LABELS = """
WITH labels_of AS (
  SELECT p_partkey, lower(trim(concat_ws(' ', p_name, p_type, p_brand))) AS label FROM part),
neighbours AS (
  SELECT a.p_partkey, a.label AS p, b.label AS t FROM labels_of a JOIN labels_of b ON b.p_partkey = a.p_partkey + 1),
"""

STATEMENTS = {
    "text_similarity": _LABELS
    + similarity_ctes("SELECT p, t FROM neighbours")
    + "SELECT p_partkey, round(similarity, 6) AS similarity FROM neighbours JOIN similarities USING (p, t)",
    "sections": _FILINGS
    + "SELECT doc_id, item, heading, start_at, end_at, md5(body) AS digest FROM sections",
    "sections_lookup": _FILINGS
    + """SELECT doc_id,
       (SELECT string_agg(item, ',' ORDER BY start_at) FROM sections x WHERE x.doc_id = t.doc_id)
         AS items,
       EXISTS (SELECT 1 FROM sections x WHERE x.doc_id = t.doc_id AND item = '1A') AS has_1a,
       md5(coalesce((SELECT body FROM sections x WHERE x.doc_id = t.doc_id AND item = '8'),
                    'none')) AS digest_8,
       CAST(c4 AS BIGINT) AS cover_chars
FROM texts t""",
    "filing_requests": _FILINGS
    + f"""SELECT doc_id, 'You read annual filings.' AS system, md5({_FILING_MESSAGE}) AS digest,
       CAST(length({_FILING_MESSAGE}) AS BIGINT) AS n_chars FROM texts""",
    "document_requests": f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'You read invoices.' ELSE 'You read receipts.' END
         AS system, md5({_document_message('t')}) AS digest
FROM (SELECT doc_id, text AS t FROM documents)""",
    "html_to_text": f"""
WITH bare AS (
  SELECT page_id, replace(replace(replace(replace(replace(
           regexp_replace(regexp_replace(html, '{_MARKUP}', chr(1), 'g'), chr(1) || '+', chr(10),
                          'g'),
           '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&') AS t
  FROM pages),
tidy AS (
  SELECT page_id, trim(regexp_replace(array_to_string(list_transform(
           string_split(t, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), chr(10)),
           '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9)) || chr(10) AS t
  FROM bare)
SELECT page_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM tidy""",
    "admit_documents": _FILES
    + f"""SELECT page_id, {_REFUSAL.format(empty=_EMPTY)} AS refusal,
       {_STATUS.format(r=_REFUSAL.format(empty=_EMPTY))} AS status,
       {_STATUS.format(r=_REFUSAL.format(empty=''))} AS batch_status FROM files""",
    "route_documents": _FILES
    + """, routed AS (
  SELECT page_id, html, CASE WHEN ext IN ('.png', '.jpeg') THEN 'image'
         WHEN ext = '.pdf' OR is_pdf THEN 'pdf' WHEN ext IN ('.txt', '.md') THEN 'text'
         ELSE 'empty' END AS source_type FROM files)
SELECT page_id, source_type,
       md5(CASE WHEN source_type = 'text' THEN trim(html, ' ' || chr(9) || chr(10)) ELSE '' END)
         AS digest,
       CASE source_type WHEN 'image' THEN 1 WHEN 'text' THEN 1 WHEN 'empty' THEN 0 END
         AS page_count FROM routed""",
    "ft_rows": _LABELLED
    + f"""SELECT doc_id, CASE WHEN problem IS NULL THEN 'You read receipts.' END AS system,
       CASE WHEN problem IS NULL THEN md5({_document_message('text')}) END AS user_digest,
       CASE WHEN problem IS NULL THEN
         '{{"data":{{"source":"' || source || '","lang":"' || lang || '","note":"Gr\\u00f6\\u00dfe",'
         || '"quality":' || quality || ',"toxic":' || toxic
         || '}},"field_confidences":[],"warnings":[]}}' END AS assistant, problem FROM docs""",
    "ft_sink_roundtrip": _LABELLED
    + f""", n AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT))
                        AS v FROM docs WHERE problem IS NULL)
SELECT 'system,user,assistant' AS roles, 'You read receipts.' AS system,
       md5({_document_message('text')}) AS user_digest,
       '{{"data":{{"source":"' || source || '","lang":"' || lang || '","note":"Gr\\u00f6\\u00dfe",'
         || '"quality":' || quality || ',"toxic":' || toxic
         || '}},"field_confidences":[],"warnings":[]}}' AS assistant, n - v AS n_train, v AS n_val
FROM docs, n WHERE problem IS NULL""",
    "ft_split_sizes": _LABELLED
    + """, n AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT))
                        AS v FROM docs WHERE problem IS NULL)
SELECT 'val' AS split, v AS n_rows, CAST(NULL AS VARCHAR) AS warning FROM n
UNION ALL
SELECT 'train', n - v, CASE WHEN n - v < 10 THEN 'fewer than 10 training rows' END FROM n""",
    "infer_partitions": """
SELECT doc_id AS id,
       CASE WHEN ok THEN '{"total":' || length(text) || '}' END AS raw,
       CASE WHEN ok THEN 'stub' END AS model,
       CASE WHEN ok THEN CAST(length(text) // 4 AS BIGINT) END AS input_tokens,
       CASE WHEN ok THEN CAST(5 AS BIGINT) END AS output_tokens,
       CASE WHEN ok THEN CAST(length(text) % 100 AS DOUBLE) END AS latency_ms,
       CASE WHEN NOT ok THEN 'refused' END AS error
FROM (SELECT *, doc_id % 10 <> 3 AS ok FROM documents)""",
}
