"""DuckDB statements for the preparation queries."""

from __future__ import annotations


def _choose(key: str, *options: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {key} % {len(options)} {whens} END"


def _money_text(key: str, x: str) -> str:
    grouped = f"format('{{:,.2f}}', {x})"
    plain = f"printf('%.2f', {x})"
    return _choose(
        key,
        f"'$' || {grouped}",
        f"translate({grouped}, ',.', '.,')",
        f"'SGD ' || {plain}",
        f"translate({plain}, '.', ',')",
        "'total:'",
        f"{plain} || ' USD'",
        f"'£' || CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)",
        f"format('{{:,}}', CAST(floor({x}) AS BIGINT))",
        f"'(' || {grouped} || ')'",
    )


def _parse_money(raw: str) -> str:
    kept = f"regexp_replace({raw}, '[^0-9.,-]', '', 'g')"
    european = f"regexp_matches({kept}, ',[^.]*$')"  # no dot after the last comma
    plain = (
        f"CASE WHEN {european} THEN replace(replace({kept}, '.', ''), ',', '.') "
        f"ELSE replace({kept}, ',', '') END"
    )
    return f"CAST(printf('%.2f', TRY_CAST(nullif({plain}, '') AS DOUBLE)) AS DOUBLE)"


_STRFTIME = [
    "%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y", "%d-%m-%y",
    "%d/%m/%y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%Y%m%d",
]


def _date_text(key: str, d: str) -> str:
    options = [f"strftime({d}, '{f}')" for f in _STRFTIME]
    return _choose(key, *options, f"strftime({d}, '%m/%d/%y')", "'nonsense'")


def _parse_date(raw: str) -> str:
    tries = []
    for f in _STRFTIME:
        year = "[0-9]{4}" if "%Y" in f else "[0-9]{2}"
        shape = {"%Y-%m-%d": f"^{year}-", "%Y/%m/%d": f"^{year}/", "%Y%m%d": "^[0-9]{8}$"}.get(
            f, f"[^0-9]{year}$"
        )
        tries.append(
            f"CASE WHEN regexp_matches({raw}, '{shape}') THEN try_strptime({raw}, '{f}') END"
        )
    return f"CAST(coalesce({', '.join(tries)}) AS DATE)"


_FLAT = f"""
WITH src AS (
  SELECT o_orderkey AS k, o_totalprice AS total, c_name,
         {_money_text('o_orderkey', 'o_totalprice')} AS total_text,
         {_date_text('o_orderkey', 'o_orderdate')} AS date_text
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
parsed AS (
  SELECT *, {_parse_money('total_text')} AS styled, {_parse_date('date_text')} AS d,
         k % 5 IN (3, 4) AS by_number
  FROM src),
judged AS (
  SELECT *, CASE WHEN by_number THEN CASE WHEN k % 37 = 0 THEN -5e0 ELSE total END
                 ELSE styled END AS amount
  FROM parsed),
flat AS (
  SELECT *, CASE WHEN k % 41 = 0 THEN 'invalid_json'
                 WHEN k % 47 = 0 THEN 'not_an_object'
                 WHEN k % 43 = 0 THEN 'missing_company'
                 WHEN amount IS NULL THEN 'missing_total'
                 WHEN amount < 0 THEN 'negative_total' END AS reason
  FROM judged)
"""

# The record's own id is only visible where the annotation is not wrapped.
_FLAT_ID = (
    "CASE WHEN k % 41 <> 0 AND k % 47 <> 0 AND k % 3 = 0 AND k % 5 IN (0, 4) "
    "THEN 'R-' || k ELSE printf('sroie_%05d', k) END"
)

_MENU = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS e
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
listed AS (
  SELECT l_orderkey, count(*) AS n, sum(e) AS e FROM lines WHERE l_linenumber <> 5
  GROUP BY l_orderkey),
menu AS (
  SELECT o_orderkey AS k, o_totalprice AS total, c_name,
         CASE WHEN o_orderkey % 10 = 7 THEN 0 ELSE coalesce(n, 0) END AS n,
         CASE WHEN o_orderkey % 10 = 7 THEN 0 ELSE coalesce(e, 0) END AS e,
         CASE WHEN o_orderkey % 61 = 0 THEN 'not_an_object'
              WHEN o_orderkey % 59 = 0 AND o_orderkey % 10 <> 7 AND coalesce(n, 0) > 0
                THEN 'negative_quantity'
              WHEN o_orderkey % 53 = 0 THEN 'missing_total' END AS reason
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN listed ON l_orderkey = o_orderkey)
"""

STATEMENTS = {
    "parse_money_styles": f"""
SELECT o_orderkey, raw, {_parse_money('raw')} AS amount
FROM (SELECT o_orderkey, {_money_text('o_orderkey', 'o_totalprice')} AS raw FROM orders)""",
    "parse_date_formats": f"""
SELECT o_orderkey, raw, {_parse_date('raw')} AS parsed
FROM (SELECT o_orderkey, {_date_text('o_orderkey', 'o_orderdate')} AS raw FROM orders)""",
    "clean_text_docs": """
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}]+', ' ', 'g')), '')
             AS t FROM documents)""",
    "currency_cik_norm": """
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN upper(substring(c_mktsegment, 1, 3)) END
         AS currency,
       CASE WHEN c_custkey % 5 <> 0 THEN upper(substring(c_mktsegment, 1, 3)) ELSE 'USD' END
         AS filing_currency,
       CASE c_custkey % 4 WHEN 2 THEN 'CIK' || c_custkey WHEN 3 THEN '990000000000' || c_custkey
            ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik
FROM customer""",
    "normalize_receipts_flat": _FLAT
    + f"""
SELECT {_FLAT_ID} AS id, 'sroie' AS source,
       CASE WHEN reason IS NULL THEN c_name END AS merchant,
       CASE WHEN reason IS NULL AND k % 4 <> 0 THEN k || ' Main Street' END AS line1,
       CASE WHEN reason IS NULL THEN d END AS transaction_date,
       CASE WHEN reason IS NULL THEN 0 END AS n_items, 0e0 AS items_total,
       CAST(NULL AS DOUBLE) AS subtotal,
       CASE WHEN reason IS NULL THEN amount END AS total,
       CASE WHEN reason IS NULL THEN 'SGD' END AS currency, reason
FROM flat""",
    "normalize_receipts_menu": _MENU
    + """
SELECT printf('cord_%05d', k) AS id, 'cord' AS source,
       CASE WHEN reason IS NULL THEN CASE WHEN k % 8 = 0 THEN c_name ELSE 'Unknown merchant' END
       END AS merchant,
       CAST(NULL AS VARCHAR) AS line1, CAST(NULL AS DATE) AS transaction_date,
       CASE WHEN reason IS NULL THEN CAST(n AS INTEGER) END AS n_items,
       CASE WHEN reason IS NULL THEN CAST(e AS DOUBLE) ELSE 0e0 END AS items_total,
       CASE WHEN reason IS NULL AND k % 6 <> 0 THEN total END AS subtotal,
       CASE WHEN reason IS NULL THEN total END AS total,
       CASE WHEN reason IS NULL THEN 'KRW' END AS currency, reason
FROM menu""",
    "prepared_receipts": _FLAT
    + ", "
    + _MENU.strip().removeprefix("WITH")
    + """
SELECT source, coalesce(reason, 'usable') AS reason, count(*) AS n_rows
FROM (SELECT 'sroie' AS source, reason FROM flat UNION ALL
      SELECT 'cord', reason FROM menu) GROUP BY ALL""",
    "first_flat_receipts": _FLAT
    + f"SELECT k AS pos, {_FLAT_ID} AS id FROM flat WHERE reason IS NULL ORDER BY k LIMIT 100",
    "row_positions": "SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders",
    # Eighths are exact in decimals, so the tie rule is plain integer arithmetic here.
    "round_exact_large": """
WITH scaled AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS sign,
         (10000000000 * (o_orderkey % 1000 + 1) + o_orderkey)::HUGEINT * 1000 + (o_orderkey % 8) * 125 AS v
  FROM orders)
SELECT o_orderkey, sign * ((v // 10 + CASE WHEN v % 10 > 5 OR (v % 10 = 5 AND (v // 10) % 2 = 1) THEN 1 ELSE 0 END)
       ::DOUBLE / 100e0) AS rounded FROM scaled""",
}
