"""DuckDB statements for validation, filings, roll-ups and tracking."""

from __future__ import annotations

from fieldledger.operators.filings import FIGURES
from fieldledger.plans.oracle_eval import BASE
from fieldledger.plans.oracle_prep import _choose

# --- validation ---------------------------------------------------------------------------------

_ENVELOPES = """
WITH items AS (
  SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
src AS (
  SELECT o_orderkey AS k, o_totalprice AS total, coalesce(n, 0) AS n
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey),
judged AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN ['invalid_json'] ELSE list_sort(list_filter([
      CASE WHEN k % 63 = 0 THEN 'type:data.invoice_number' END,
      CASE WHEN k % 53 = 0 THEN 'missing:data.vendor.name' END,
      CASE WHEN k % 53 <> 0 AND k % 55 = 0 THEN 'extra:data.vendor.site' END,
      CASE WHEN k % 49 = 0 AND n > 0 THEN 'range:data.line_items[].quantity' END,
      CASE WHEN k % 51 = 0 AND n > 0 THEN 'range:data.line_items[].tax_rate' END,
      CASE WHEN k % 35 = 0 THEN 'missing:data.total'
           WHEN k % 39 = 0 THEN 'range:data.total'
           WHEN k % 46 = 0 THEN NULL
           WHEN k % 47 = 0 THEN 'type:data.total' END,
      CASE WHEN k % 57 = 0 THEN 'type:data.due_date' END,
      CASE WHEN k % 33 = 0 THEN 'extra:data.foo' END,
      CASE WHEN k % 59 = 0 THEN 'range:field_confidences[].score' END,
      CASE WHEN k % 61 = 0 THEN 'choice:warnings[].severity' END],
      lambda x: x IS NOT NULL)) END AS reasons
  FROM src)
"""

# --- filings ------------------------------------------------------------------------------------

_PICKS = ", ".join(
    f"({n}, '{c}', '{figure}', {rank})"
    for n, (figure, rank, c) in enumerate(
        (figure, rank, c) for figure, cs in FIGURES.items() for rank, c in enumerate(cs)
    )
)
_N = sum(len(cs) for cs in FIGURES.values())
_FACTS = f"""
WITH picks(n, concept, figure, rank) AS (VALUES {_PICKS}),
facts AS (
  SELECT l_suppkey AS stem, concept, figure, rank, year(l_shipdate) || '-12-31' AS fy,
         {_choose('l_orderkey', "'10-K'", "'10-Q'", "'10-K/A'")} AS form,
         l_partkey % 2 = 0 AS annual,
         CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_extendedprice AS DECIMAL(15,2)) END AS val,
         row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place
  FROM lineitem JOIN picks
    ON n = (ascii(l_returnflag) * 7 + ascii(l_linestatus) * 3 + l_linenumber * 5) % {_N}),
best AS (
  SELECT stem, fy, figure, rank, arg_min(val, place) AS val FROM facts
  WHERE form LIKE '10-K%' AND annual AND val IS NOT NULL GROUP BY ALL),
periods AS (
  SELECT s_suppkey AS stem, (1996 + s_suppkey % 5) || '-12-31' AS fy_end FROM supplier),
figures AS (
  SELECT p.stem, fy_end, {", ".join(
    f"CAST(sum(val) FILTER (WHERE figure = '{f}') AS DOUBLE) AS {f}" if f == "total_debt" else
    f"CAST(arg_min(val, rank) FILTER (WHERE figure = '{f}') AS DOUBLE) AS {f}" for f in FIGURES)},
    'USD' AS currency, CAST(substring(fy_end, 1, 4) AS INTEGER) AS fiscal_year
  FROM periods p LEFT JOIN best b ON p.stem = b.stem AND fy = fy_end GROUP BY p.stem, fy_end)
"""

_NEWEST = """
WITH newest AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik10, o_custkey AS cik,
         arg_min(row(o_orderkey, strftime(o_orderdate, '%Y-%m-%d')),
                 row(-date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), o_orderkey))
           AS b
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
named AS (
  SELECT cik10, cik, b[1] AS k, b[2] AS filing_date,
         '0000-' || lpad(CAST(b[1] AS VARCHAR), 8, '0') || '-26' AS accession
  FROM newest),
urls AS (
  SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' ||
            replace(accession, '-', '') || '/d' || k || '.htm' AS source_url FROM named)
"""

_ROLLED = (
    BASE
    + """, rolled AS (
  SELECT model, effort, model || coalesce('@' || effort, '') AS label,
         CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(errors) AS BIGINT) AS errors,
         CAST(printf('%.4f', sum(micro_f1 * n_docs) / sum(n_docs)) AS DOUBLE) AS micro_f1,
         CAST(printf('%.4f', sum(macro_f1 * n_docs) / sum(n_docs)) AS DOUBLE) AS macro_f1,
         CAST(printf('%.4f', sum(doc_exact_match * n_docs) / sum(n_docs)) AS DOUBLE) AS doc_exact_match,
         CAST(printf('%.0f', sum(mean_latency_ms * n_docs) / sum(n_docs)) AS DOUBLE) AS mean_latency_ms,
         CAST(printf('%.4f', sum(total_cost_usd)) AS DOUBLE) AS total_cost_usd
  FROM summary GROUP BY model, effort),
combos(pos, model, effort, label) AS (VALUES
  (0, 'alpha', 'minimal', 'alpha@minimal'), (1, 'beta', NULL, 'beta'),
  (2, 'gamma', 'high', 'gamma@high'))
"""
)

# --- tracking -----------------------------------------------------------------------------------

_JOBS = """
WITH e AS (
  SELECT user_id AS job_id, event_id % 20 AS item, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done'
              WHEN 'error' THEN 'error' ELSE 'running' END AS status FROM events),
latest AS (
  SELECT job_id, item, arg_max(status, seq) AS status, bool_or(status = 'running') AS started
  FROM e GROUP BY job_id, item),
progress AS (
  SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done,
         count(*) FILTER (WHERE status = 'error') AS errors,
         count(*) FILTER (WHERE status = 'pending') AS pending,
         count(*) FILTER (WHERE status = 'running') AS running, bool_or(started) AS started
  FROM latest GROUP BY job_id),
judged AS (
  SELECT *, CASE WHEN done + errors = total THEN 'done' WHEN started THEN 'running'
                 ELSE 'pending' END AS status FROM progress)
"""

_STAGES = """
WITH e AS (
  SELECT event_id // 6 AS request_id, event_id % 6 AS slot, event_type, ts FROM events),
t AS (
  SELECT request_id, min(ts) FILTER (WHERE slot = 0) AS t0,
         min(ts) FILTER (WHERE slot = 1) AS t1, min(ts) FILTER (WHERE slot = 2) AS t2,
         min(ts) FILTER (WHERE slot = 3 AND event_type <> 'error') AS t3,
         min(ts) FILTER (WHERE slot = 3 AND event_type = 'error') AS tx,
         min(ts) FILTER (WHERE slot = 4) AS t4, min(ts) FILTER (WHERE slot = 5) AS t5
  FROM e GROUP BY request_id),
timing AS (
  SELECT request_id,
         (epoch_us(t1) - epoch_us(t0)) // 1000 AS loading_ms,
         (epoch_us(t2) - epoch_us(t0)) // 1000 AS model_call_ms,
         (epoch_us(t3) - epoch_us(t0)) // 1000 AS validated_ms,
         (epoch_us(t4) - epoch_us(t0)) // 1000 AS result_ms,
         (epoch_us(tx) - epoch_us(t0)) // 1000 AS error_ms,
         (epoch_us(t5) - epoch_us(t0)) // 1000 AS done_ms,
         CASE WHEN tx IS NOT NULL THEN 'error' WHEN t5 IS NOT NULL THEN 'ok' ELSE 'open' END
           AS outcome, t5
  FROM t)
"""

STATEMENTS = {
    "validate_invoices": _ENVELOPES
    + """SELECT CAST(k AS VARCHAR) AS doc_id, 'invoice' AS document_type, 'Northwind' AS vendor,
       total, CASE WHEN k % 44 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
       CASE WHEN k % 2 = 0 THEN DATE '2020-02-29' END AS due_date, CAST(n AS INTEGER) AS n_items,
       0.375e0 AS overall_confidence, CAST(1 AS INTEGER) AS n_warnings,
       CASE WHEN k % 5 <> 0 THEN 'order ' || k END AS raw_text_snippet
FROM judged WHERE len(reasons) = 0""",
    "validate_rejects": _ENVELOPES
    + """SELECT CAST(k AS VARCHAR) AS doc_id, array_to_string(reasons, ';') AS reasons
FROM judged WHERE len(reasons) > 0""",
    "flatten_invoices": BASE
    + """SELECT CAST(k AS VARCHAR) AS doc_id, path, ftype,
       coalesce(s, regexp_replace(printf('%.4f', x), '\\.?0+$', '')) AS shown
FROM truth_fields WHERE model = 'alpha' AND (s IS NOT NULL OR x IS NOT NULL)""",
    "selfcheck_f1": BASE
    + """SELECT dataset, path, count(*) FILTER (WHERE s IS NOT NULL OR x IS NOT NULL) AS tp,
       CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn,
       count(*) FILTER (WHERE s IS NULL AND x IS NULL) AS tn,
       CASE WHEN count(s) + count(x) > 0 THEN 1e0 ELSE 0e0 END AS f1
FROM truth_fields t JOIN heads h ON t.k = h.k WHERE model = 'alpha' GROUP BY dataset, path""",
    "call_metrics": BASE
    + """SELECT CAST(k AS VARCHAR) AS doc_id, model,
       CAST(100 + r % 50 AS INTEGER) AS input_tokens, CAST(20 + r % 7 AS INTEGER) AS output_tokens,
       CAST(120 + r % 50 + r % 7 AS INTEGER) AS total_tokens,
       round(1000e0 + r % 997, 1) AS latency_ms,
       (100 + r % 50) / 1000e0 * CASE model WHEN 'beta' THEN 0.001e0 ELSE 0.00005e0 END
         + (20 + r % 7) / 1000e0 * CASE model WHEN 'beta' THEN 0.002e0 ELSE 0.0004e0 END
         AS exact_cost
FROM runs WHERE ok""",
    "xbrl_financials": _FACTS + "SELECT * FROM figures",
    "nested_facts_readback": _FACTS
    + """SELECT stem, concept, count(*) AS n, CAST(sum(val) AS DOUBLE) AS total
FROM facts GROUP BY stem, concept""",
    "latest_filing": _NEWEST
    + """SELECT cik10, '10-K' AS form, filing_date, source_url, 'ABC_' || filing_date || '_10k' AS stem
FROM urls""",
    "filing_sidecars": _NEWEST
    + """SELECT upper('t' || cik10) AS ticker, cik10, accession, source_url,
       CAST(length(text) AS INTEGER) AS text_bytes, doc_id % 2 = 0 AS has_companyfacts,
       'NYSE' AS exchange FROM urls JOIN documents ON doc_id = cik""",
    "resolve_tickers": """
SELECT 'S' || p_partkey AS ticker,
       CASE WHEN s_suppkey IS NOT NULL THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik10
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
    "filing_ground_truth": _FACTS
    + """SELECT 'filing_S' || stem || '_' || fy_end AS id, 'sec_edgar' AS source,
       md5(text) AS digest, lpad(CAST(stem AS VARCHAR), 10, '0') AS cik,
       CASE WHEN stem % 3 = 0 THEN 'NYSE' END AS exchange,
       CASE WHEN stem % 2 = 0 THEN 'DE' ELSE 'Delaware' END AS state,
       fy_end AS fiscal_year_end, fiscal_year, revenue, total_debt,
       CAST(NULL AS DOUBLE) AS free_cash_flow, CAST(0 AS INTEGER) AS n_risks
FROM figures JOIN documents ON doc_id = stem""",
    "multi_model_rollup": _ROLLED + "SELECT * EXCLUDE (label) FROM rolled",
    "base_vs_tuned": _ROLLED
    + """SELECT CASE model WHEN 'alpha' THEN 'alpha' ELSE 'fine-tuned' END AS label,
       micro_f1, macro_f1, doc_exact_match, n_docs, errors FROM rolled""",
    "matrix_missing": _ROLLED
    + """SELECT CAST(c.pos AS BIGINT) AS pos, c.label, coalesce(c.effort, '—') AS effort,
       coalesce(CAST(n_docs AS VARCHAR), '') AS docs_text,
       coalesce(CAST(errors AS VARCHAR), '—') AS errors_text
FROM combos c LEFT JOIN rolled r ON c.label = r.label""",
    "run_matrix": _ROLLED
    + """SELECT c.label, 'invoice' AS doc_type, d.dataset, s.n_docs, s.n_docs IS NOT NULL AS has_run
FROM combos c CROSS JOIN (VALUES ('f'), ('o'), ('p'), ('x')) d(dataset)
LEFT JOIN summary s ON s.model = c.model AND s.effort IS NOT DISTINCT FROM c.effort
  AND s.dataset = d.dataset""",
    "report_field_table": BASE
    + """SELECT model, effort, dataset, path AS field, ftype AS field_type, tp, fp, fn, tn, support,
       row_number() OVER (PARTITION BY model, effort, dataset
                          ORDER BY support DESC, f1 DESC, path) AS place
FROM field_stats WHERE support > 0 OR fp > 0""",
    "job_progress": _JOBS
    + """SELECT c_custkey AS job_id, coalesce(total, 0) AS total, coalesce(done, 0) AS done,
       coalesce(errors, 0) AS errors, coalesce(pending, 0) AS pending,
       coalesce(running, 0) AS running, coalesce(status, 'done') AS status
FROM customer LEFT JOIN judged ON job_id = c_custkey""",
    "job_snapshot": _JOBS
    + """SELECT j.job_id, j.status, total, l.page, l.items
FROM judged j JOIN (
  SELECT job_id, CAST(floor(item / 1000) AS BIGINT) AS page,
         string_agg(item || ':' || status, ',' ORDER BY item) AS items
  FROM latest GROUP BY ALL) l ON l.job_id = j.job_id""",
    "job_progress_stream": _JOBS
    + "SELECT job_id, total, done, errors, pending, running, status FROM judged",
    "stage_timing": _STAGES + "SELECT * EXCLUDE (t5) FROM timing",
    "stage_timing_stream": _STAGES + "SELECT * EXCLUDE (t5) FROM timing",
    "incremental_scores": BASE
    + "SELECT model, effort, dataset, path, tp, fp, fn, tn, support, f1 FROM field_stats",
}
