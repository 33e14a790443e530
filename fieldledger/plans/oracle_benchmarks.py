"""DuckDB statements of the receipt and filing benchmarks and of the round trips."""

from __future__ import annotations

from fieldledger.operators.filings import FIGURES
from fieldledger.plans.oracle_eval import BASE
from fieldledger.plans.oracle_similarity import similarity_ctes

_HEADS = """
WITH heads AS (
  SELECT o_orderkey AS k, lower(o_orderstatus) AS dataset, o_orderdate AS date,
         strftime(o_orderdate, '%Y-%m-%d') AS day,
         o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 2e10 ELSE 0e0 END AS total,
         c_name AS name, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_CLOCK = "printf('%02d:%02d:00', k % 24, k % 60)"

# path, comparator, truth text, truth number, predicted text, predicted number, condition of presence
_RECEIPT = [
    ("merchant", "text", "name", "NULL",
     "CASE WHEN k % 3 = 0 THEN name || 'x' WHEN k % 11 = 0 THEN name[1:12] WHEN k % 13 = 0 THEN name[1:15] ELSE name END",
     "NULL"),
    ("merchant_phone", "exact", "NULL", "NULL", "NULL", "NULL"),
    ("transaction_date", "date", "day", "NULL", "day", "NULL"),
    ("transaction_time", "time", _CLOCK, "NULL", f"CASE WHEN k % 5 = 0 THEN '23:59:59' ELSE {_CLOCK} END", "NULL"),
    ("receipt_number", "exact", "'r' || k", "NULL", "'r' || k", "NULL"),
    ("line_items[]", "number", "NULL", "1", "NULL", "CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END"),
    ("line_items[0].description", "text", "priority", "NULL", "priority", "NULL"),
    ("line_items[0].quantity", "number", "NULL", "k % 3 + 1", "NULL", "k % 3 + 1"),
    ("line_items[0].unit_price", "money", "NULL", "NULL", "NULL", "NULL"),
    ("line_items[0].total", "money", "NULL", "total", "NULL", "total"),
    ("line_items[1].description", "text", "NULL", "NULL", "priority", "NULL", "k % 17 = 0"),
    ("line_items[1].quantity", "number", "NULL", "NULL", "NULL", "k % 3 + 1", "k % 17 = 0"),
    ("line_items[1].unit_price", "money", "NULL", "NULL", "NULL", "NULL", "k % 17 = 0"),
    ("line_items[1].total", "money", "NULL", "NULL", "NULL", "total", "k % 17 = 0"),
    ("subtotal", "money", "NULL", "NULL", "NULL", "NULL"),
    ("tax", "money", "NULL", "NULL", "NULL", "NULL"),
    ("tip", "money", "NULL", "NULL", "NULL", "CASE WHEN k % 19 = 0 THEN 1.5 END"),
    ("total", "money", "NULL", "total", "NULL", "CASE WHEN k % 7 = 0 THEN total * 1.01e0 ELSE total END"),
    ("currency", "exact", "'USD'", "NULL", "'USD'", "NULL"),
    ("payment_method", "exact", "CASE WHEN k % 2 = 0 THEN 'CASH' END", "NULL",
     "CASE WHEN k % 2 = 0 THEN 'cash' END", "NULL"),
]

_CIK = "lpad(k::VARCHAR, 10, '0')"
_N = "k % 6"
_NP = "CASE WHEN k % 4 = 0 THEN greatest(k % 6 - 1, 0) ELSE k % 6 END"
_FILING = [
    ("cover.company_name", "text", "name", "NULL", "CASE WHEN k % 3 = 0 THEN upper(name) ELSE name END", "NULL"),
    ("cover.cik", "text", _CIK, "NULL", f"CASE WHEN k % 7 = 0 THEN '0000000000' ELSE {_CIK} END", "NULL"),
    ("cover.ticker", "text", "NULL", "NULL", "NULL", "NULL"),
    ("cover.exchange", "text", "NULL", "NULL", "NULL", "NULL"),
    ("cover.form_type", "text", "'10-K'", "NULL", "'10-K'", "NULL"),
    ("cover.fiscal_year_end", "date", "day", "NULL", "day", "NULL"),
    ("cover.filing_date", "date", "NULL", "NULL", "NULL", "NULL"),
    ("cover.state_of_incorporation", "text", "NULL", "NULL", "NULL", "NULL"),
    ("financials.currency", "exact", "'USD'", "NULL", "'USD'", "NULL"),
    ("financials.fiscal_year", "number", "NULL", "year(date)", "NULL",
     "CASE WHEN k % 9 = 0 THEN year(date) + 1 ELSE year(date) END"),
    ("financials.revenue", "number", "NULL", "total", "NULL", "CASE WHEN k % 8 = 0 THEN total + 0.01e0 ELSE total END"),
    ("financials.net_income", "number", "NULL", "total / 4", "NULL", "CASE WHEN k % 10 <> 0 THEN total / 4 END"),
    *[
        (f"financials.{name}", "number", "NULL", "NULL", "NULL", "NULL")
        for name in (
            "cost_of_revenue", "gross_profit", "operating_income", "eps_basic", "eps_diluted",
            "cash_and_equivalents", "total_debt", "total_assets", "total_equity", "operating_cash_flow",
            "free_cash_flow",
        )
    ],
    ("top_risk_factors[]", "number", "NULL", _N, "NULL", _NP),
    *[
        (f"top_risk_factors[{i}].{leaf}", "text", f"CASE WHEN {i} < {_N} THEN {truth} END", "NULL",
         f"CASE WHEN {i} < {_NP} THEN {wrong} END", "NULL", f"{i} < {_N}")
        for i in range(5)
        for leaf, truth, wrong in (
            ("theme", f"'supply risk {i}'",
             f"CASE WHEN k % 5 = 0 AND {i} = 0 THEN 'weather' ELSE 'supply risk {i}' END"),
            ("summary", "priority", "priority"),
        )
    ],
]


def _outcomes(fields: list[tuple]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT k, dataset, '{f[0]}' AS path, '{f[1]}' AS ftype, CAST({f[2]} AS VARCHAR) AS ts,"
        f" CAST({f[3]} AS DOUBLE) AS tx, CAST({f[4]} AS VARCHAR) AS ps, CAST({f[5]} AS DOUBLE) AS px"
        f" FROM heads WHERE {f[6] if len(f) > 6 else 'TRUE'}"
        for f in fields
    )
    texts = "SELECT lower(trim(ps)) AS p, lower(trim(ts)) AS t FROM long WHERE ftype = 'text' AND ps IS NOT NULL AND ts IS NOT NULL"
    return f"""{_HEADS},
long AS ({rows}),
{similarity_ctes(texts)},
outcomes AS (
  SELECT long.*, CASE
    WHEN ts IS NULL AND tx IS NULL AND ps IS NULL AND px IS NULL THEN 'TN'
    WHEN ps IS NULL AND px IS NULL THEN 'FN' WHEN ts IS NULL AND tx IS NULL THEN 'FP'
    WHEN CASE ftype
      WHEN 'money' THEN abs(px - tx) <= 0.01e0 OR (tx <> 0 AND abs(px - tx) / abs(tx) <= 0.005e0)
      WHEN 'number' THEN abs(px - tx) <= 1e-6
      WHEN 'text' THEN similarity >= 0.85e0
      ELSE lower(trim(ps)) = lower(trim(ts)) END THEN 'TP' ELSE 'MISMATCH' END AS outcome
  FROM long LEFT JOIN similarities s ON ftype = 'text' AND s.p = lower(trim(ps)) AND s.t = lower(trim(ts)))"""


def _stats(fields: list[tuple]) -> str:
    return f"""{_outcomes(fields)},
counts AS (
  SELECT dataset, path, ftype, count(*) FILTER (WHERE outcome = 'TP') AS tp,
         count(*) FILTER (WHERE outcome IN ('FP', 'MISMATCH')) AS fp,
         count(*) FILTER (WHERE outcome IN ('FN', 'MISMATCH')) AS fn,
         count(*) FILTER (WHERE outcome = 'TN') AS tn
  FROM outcomes GROUP BY ALL),
rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM counts)
SELECT 'alpha' AS model, NULL::VARCHAR AS effort, dataset, path, ftype, tp, fp, fn, tn, tp + fn AS support,
       precision, recall, CASE WHEN precision + recall = 0 THEN 0e0
         ELSE 2e0 * precision * recall / (precision + recall) END AS f1 FROM rated"""


_MAPPED = ", ".join(
    f"('{concept}', '{name}', {rank})" for name, concepts in FIGURES.items() for rank, concept in enumerate(concepts)
)
_CONCEPTS = ", ".join(f"'{c}'" for concepts in FIGURES.values() for c in concepts)

STATEMENTS = {
    "eval_receipt_stats": _stats(_RECEIPT),
    "eval_filing_stats": _stats(_FILING),
    "validate_filings": """
WITH rows AS (
  SELECT o_orderkey AS k, o_orderkey % 8 AS n, o_totalprice + 3e10 AS revenue,
         CASE WHEN o_orderkey % 11 = 0 THEN 1899 WHEN o_orderkey % 13 = 0 THEN 2101 WHEN o_orderkey % 7 = 0 THEN NULL
              ELSE 2020 END AS year FROM orders),
judged AS (
  SELECT *, list_sort(list_filter([
      CASE WHEN year < 1900 OR year > 2100 THEN 'range:data.financials.fiscal_year' END,
      CASE WHEN n > 5 THEN 'range:data.top_risk_factors' END], lambda x: x IS NOT NULL)) AS reasons FROM rows)
SELECT k::VARCHAR AS doc_id, array_to_string(reasons, ';') AS reasons,
       CASE WHEN len(reasons) = 0 THEN lpad(k::VARCHAR, 10, '0') END AS cik,
       CASE WHEN len(reasons) = 0 THEN '10-K' END AS form_type,
       CASE WHEN len(reasons) = 0 THEN 'USD' END AS currency,
       CASE WHEN len(reasons) = 0 THEN year::BIGINT END AS fiscal_year,
       CASE WHEN len(reasons) = 0 THEN printf('%.2f', revenue)::DOUBLE END AS revenue,
       CASE WHEN len(reasons) = 0 THEN n::INTEGER END AS n_risks
FROM judged""",
    "jsonl_roundtrip": f"""{_HEADS}
SELECT k::VARCHAR AS id, dataset AS source, name AS merchant, day AS transaction_date,
       {_CLOCK} AS transaction_time, total, NULL::DOUBLE AS tip, (k % 3 + 1)::DOUBLE AS quantity,
       (SELECT count(*) FROM heads) AS n_written FROM heads""",
    "summary_roundtrip": BASE
    + """SELECT model, effort, dataset, label, n_docs, errors, micro_f1, macro_f1, doc_exact_match, total_cost_usd
FROM summary""",
    "per_record_roundtrip": f"""{_outcomes(_RECEIPT)}
SELECT 'receipt_alpha_' || dataset AS tag, path AS field, ftype AS field_type, outcome, count(*) AS n
FROM outcomes WHERE outcome <> 'TN' GROUP BY ALL""",
    "submissions_latest": """
SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik10, 'N' AS company_name, '10-K' AS form,
       '0000-' || lpad(o_orderkey::VARCHAR, 8, '0') || '-26' AS accession,
       strftime(o_orderdate, '%Y-%m-%d') AS filing_date, 'd' || o_orderkey || '.htm' AS primary_doc
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
      FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""",
    "facts_first_unit": f"""
WITH mapped(concept, figure, rank) AS (VALUES {_MAPPED}),
reported AS (
  SELECT *, [{_CONCEPTS}][(ascii(l_returnflag) * 7 + ascii(l_linestatus) * 3 + l_linenumber * 5) % {_CONCEPTS.count(',') + 1} + 1] AS concept,
         year(l_shipdate) || '-12-31' AS "end", CASE WHEN l_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
         printf('%.2f', l_extendedprice) AS val
  FROM lineitem),
usable AS (
  SELECT * FROM reported WHERE l_orderkey % 3 <> 1 AND l_partkey % 2 = 0 AND l_orderkey % 13 <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, concept, "end"
    ORDER BY unit, l_linenumber, l_partkey, l_quantity, l_extendedprice, val) AS rn FROM usable)
SELECT l_orderkey AS stem, "end", figure, rank::BIGINT AS rank, val::DOUBLE AS val
FROM ranked JOIN mapped USING (concept) WHERE rn = 1""",
}
