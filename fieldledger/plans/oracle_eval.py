"""DuckDB statements for the evaluation queries, written against the relational tables only."""

from __future__ import annotations

from fieldledger.plans.oracle_similarity import similarity_ctes

_ITEM_FIELDS = [
    # name, comparator, truth text, truth number, predicted text, predicted number
    ("description", "text", "p_name", "NULL", "p_desc", "NULL"),
    ("sku", "exact", "CAST(pk AS VARCHAR)", "NULL", "CAST(pk AS VARCHAR)", "NULL"),
    ("quantity", "number", "NULL", "q", "NULL", "CASE WHEN r % 41 = 0 THEN q + 1 ELSE q END"),
    ("unit_price", "money", "NULL", "e / q", "NULL",
     "e / CASE WHEN r % 41 = 0 THEN q ELSE q END"),
    ("tax_rate", "number", "NULL", "tax", "NULL", "tax"),
    ("total", "money", "NULL", "e", "NULL", "e"),
]

_HEAD_FIELDS = [
    # path, comparator, truth text, truth number, predicted text, predicted number
    ("invoice_number", "exact", "CAST(k AS VARCHAR)", "NULL", "CAST(k AS VARCHAR)", "NULL"),
    ("invoice_date", "date", "odate", "NULL", "odate", "NULL"),
    ("vendor.name", "text", "'Northwind Paper Co'", "NULL", "'Northwind Paper Co'", "NULL"),
    ("total", "money", "NULL", "total", "NULL",
     "CASE WHEN r % 11 = 0 THEN total * 1.01e0 WHEN r % 13 = 0 THEN total * 1.003e0 "
     "ELSE total END"),
    ("currency", "exact", "'USD'", "NULL", "'USD'", "NULL"),
    ("shipping", "money", "NULL", "NULL", "NULL", "CASE WHEN r % 19 = 0 THEN 9.99e0 END"),
    ("line_items[]", "number", "NULL", "CAST(n AS DOUBLE)", "NULL",
     "CAST(CASE WHEN r % 23 = 0 AND n > 0 THEN n - 1 ELSE n END AS DOUBLE)"),
    *[
        (path, kind, "NULL", "NULL", "NULL", "NULL")
        for path, kind in [
            ("purchase_order_number", "exact"), ("due_date", "date"),
            ("service_period_start", "date"), ("service_period_end", "date"),
            ("vendor.tax_id", "exact"), ("vendor.email", "text"), ("vendor.phone", "exact"),
            ("subtotal", "money"), ("discount", "money"), ("tax", "money"),
            ("payment_terms", "text"), ("payment_instructions", "text"),
        ]
    ],
]

_CUSTOMER_FIELDS = [
    ("customer.name", "text", "c_name",
     "CASE WHEN r % 17 = 0 THEN upper(c_name) || ' LTD' WHEN r % 31 = 0 THEN 'qqqqqq wwwwww' "
     "ELSE c_name END"),
    ("customer.address.country", "exact", "n_name", "n_name"),
    *[
        (path, kind, "NULL", "NULL")
        for path, kind in [
            ("customer.address.line1", "text"), ("customer.address.line2", "text"),
            ("customer.address.city", "text"), ("customer.address.region", "text"),
            ("customer.address.postal_code", "exact"), ("customer.tax_id", "exact"),
            ("customer.email", "text"), ("customer.phone", "exact"),
        ]
    ],
]


def _long(side: str) -> str:
    """Field rows of one side: truth for every run, or predictions that succeeded."""
    text, num = (2, 3) if side == "truth" else (4, 5)
    ok = "TRUE" if side == "truth" else "ok"
    parts = [
        f"SELECT model, k, '{f[0]}' AS path, '{f[1]}' AS ftype, "
        f"CAST({f[text]} AS VARCHAR) AS s, CAST({f[num]} AS DOUBLE) AS x FROM runs WHERE {ok}"
        for f in _HEAD_FIELDS
    ]
    present = "TRUE" if side == "truth" else "r % 7 <> 0"
    parts += [
        f"SELECT model, k, '{f[0]}', '{f[1]}', CAST({f[2 if side == 'truth' else 3]} AS VARCHAR),"
        f" CAST(NULL AS DOUBLE) FROM runs WHERE {ok} AND {present}"
        for f in _CUSTOMER_FIELDS
    ]
    kept = "TRUE" if side == "truth" else "NOT (r % 23 = 0 AND i = n - 1)"
    parts += [
        f"SELECT model, k, 'line_items[' || i || '].{f[0]}', '{f[1]}', "
        f"CAST({f[text]} AS VARCHAR), CAST({f[num]} AS DOUBLE) FROM run_items "
        f"WHERE {ok} AND {kept}"
        for f in _ITEM_FIELDS
    ]
    return "\n  UNION ALL ".join(parts)


BASE = f"""
WITH lines AS (
  SELECT l_orderkey, l_linenumber,
         CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS q,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS e,
         max(l_tax) AS tax, min(l_partkey) AS pk
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
items AS (
  SELECT l.*, p_name,
         array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS swapped,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i
  FROM lines l LEFT JOIN part ON pk = p_partkey),
heads AS (
  SELECT o_orderkey AS k, lower(o_orderstatus) AS dataset,
         strftime(o_orderdate, '%Y-%m-%d') AS odate, o_totalprice AS total, c_name, n_name,
         (SELECT count(*) FROM items WHERE l_orderkey = o_orderkey) AS n
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey),
runs AS (
  SELECT *, k + shift AS r, (k + shift) % 29 <> 0 AND (k + shift) % 37 <> 0 AS ok,
         CASE WHEN (k + shift) % 29 = 0 THEN 'no prediction'
              WHEN (k + shift) % 37 = 0 THEN 'timeout' END AS error
  FROM heads, (VALUES ('alpha', 'minimal', 0), ('beta', NULL, 3)) AS m(model, effort, shift)),
run_items AS (
  SELECT runs.*, i, q, e, tax, pk, p_name,
         CASE WHEN r % 43 = 0 THEN swapped ELSE p_name END AS p_desc
  FROM runs JOIN items ON l_orderkey = k),
truth_fields AS (
  {_long("truth")}),
pred_fields AS (
  {_long("pred")}),
paired AS (
  SELECT coalesce(t.model, p.model) AS model, coalesce(t.k, p.k) AS k,
         coalesce(t.path, p.path) AS path, coalesce(t.ftype, p.ftype) AS ftype,
         t.s AS ts, t.x AS tx, p.s AS ps, p.x AS px,
         (t.s IS NULL AND t.x IS NULL) AS t_null, (p.s IS NULL AND p.x IS NULL) AS p_null
  FROM truth_fields t FULL OUTER JOIN pred_fields p
    ON t.model = p.model AND t.k = p.k AND t.path = p.path),
outcomes AS (
  SELECT paired.*, runs.effort, runs.dataset, runs.error, runs.r,
    CASE WHEN p_null AND t_null THEN 'TN' WHEN p_null THEN 'FN' WHEN t_null THEN 'FP'
         WHEN CASE paired.ftype
              WHEN 'money' THEN abs(px - tx) <= 0.01e0
                                OR (tx <> 0 AND abs(px - tx) / abs(tx) <= 0.005e0)
              WHEN 'number' THEN abs(px - tx) <= 1e-6
              WHEN 'text' THEN
                list_sort(list_distinct(string_split(lower(ps), ' '))) =
                list_sort(list_distinct(string_split(lower(ts), ' ')))
                OR list_has_all(string_split(lower(ps), ' '), string_split(lower(ts), ' '))
                OR list_has_all(string_split(lower(ts), ' '), string_split(lower(ps), ' '))
              WHEN 'date' THEN ps = ts
              ELSE lower(trim(ps)) = lower(trim(ts)) END
         THEN 'TP' ELSE 'MISMATCH' END AS outcome
  FROM paired JOIN runs ON paired.model = runs.model AND paired.k = runs.k),
counted AS (SELECT * FROM outcomes WHERE error IS NULL OR outcome <> 'TN'),
stats AS (
  SELECT model, effort, dataset, path, ftype,
         count(*) FILTER (WHERE outcome = 'TP') AS tp,
         count(*) FILTER (WHERE outcome IN ('FP', 'MISMATCH')) AS fp,
         count(*) FILTER (WHERE outcome IN ('FN', 'MISMATCH')) AS fn,
         count(*) FILTER (WHERE outcome = 'TN') AS tn
  FROM counted GROUP BY model, effort, dataset, path, ftype),
rated AS (
  SELECT *, tp + fn AS support,
         CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall
  FROM stats),
field_stats AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0e0
                 ELSE 2e0 * precision * recall / (precision + recall) END AS f1 FROM rated),
docs AS (
  SELECT runs.model, runs.effort, runs.dataset, CAST(runs.k AS VARCHAR) AS doc_id, runs.error,
         runs.r,
         count(*) FILTER (WHERE outcome = 'TP' AND runs.error IS NULL) AS fields_correct,
         count(*) FILTER (WHERE outcome <> 'TN' AND runs.error IS NULL) AS fields_total
  FROM runs LEFT JOIN counted c ON c.model = runs.model AND c.k = runs.k
  GROUP BY ALL),
doc_stats AS (
  SELECT *, error IS NULL AND fields_total > 0 AND fields_correct = fields_total AS exact_match
  FROM docs),
pooled AS (
  SELECT model, effort, dataset, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn,
         coalesce(avg(f1) FILTER (WHERE support > 0), 0e0) AS macro_f1
  FROM field_stats GROUP BY model, effort, dataset),
micro AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS mp,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS mr
  FROM pooled),
micro_macro AS (
  SELECT model, effort, dataset, tp, fp, fn, mp AS micro_precision, mr AS micro_recall,
         CASE WHEN mp + mr = 0 THEN 0e0 ELSE 2e0 * mp * mr / (mp + mr) END AS micro_f1, macro_f1
  FROM micro),
per_run AS (
  SELECT model, effort, dataset, count(*) AS n_docs, count(error) AS errors,
         avg(CASE WHEN exact_match THEN 1e0 ELSE 0e0 END) FILTER (WHERE error IS NULL) AS exact,
         avg(1000e0 + r % 997) FILTER (WHERE error IS NULL) AS latency,
         sum((100 + r % 50) / 1000e0 * 0.00005e0 + (20 + r % 7) / 1000e0 * 0.0004e0)
           FILTER (WHERE error IS NULL) AS cost
  FROM doc_stats GROUP BY model, effort, dataset),
summary AS (
  SELECT s.model, s.effort, s.dataset,
         s.model || coalesce('_re-' || s.effort, '') AS label, 'invoice' AS doc_type,
         n_docs, errors, CAST(printf('%.4f', micro_f1) AS DOUBLE) AS micro_f1, CAST(printf('%.4f', macro_f1) AS DOUBLE) AS macro_f1,
         CAST(printf('%.4f', exact) AS DOUBLE) AS doc_exact_match, CAST(printf('%.1f', latency) AS DOUBLE) AS mean_latency_ms,
         CAST(printf('%.6f', cost / (n_docs - errors)) AS DOUBLE) AS mean_cost_usd, CAST(printf('%.4f', cost) AS DOUBLE) AS total_cost_usd
  FROM per_run s JOIN micro_macro m ON s.model = m.model AND s.dataset = m.dataset)
"""


def _shown(text: str, num: str) -> str:
    fixed = f"regexp_replace(printf('%.4f', {num}), '\\.?0+$', '')"
    return f"coalesce({text}, {fixed}, '')"


STATEMENTS = {
    "eval_field_stats": BASE + "SELECT * FROM field_stats",
    "eval_field_outcomes": BASE
    + "," + similarity_ctes(
        "SELECT lower(trim(ps)) AS p, lower(trim(ts)) AS t FROM counted WHERE ftype = 'text' AND outcome = 'MISMATCH'"
    )
    + f"""
SELECT model, effort, dataset, CAST(k AS VARCHAR) AS doc_id, path AS field,
       ftype AS field_type, {_shown('ps', 'px')} AS predicted, {_shown('ts', 'tx')} AS truth, outcome,
       CAST(printf('%.3f', CASE
         WHEN outcome IN ('FN', 'FP') THEN 0e0
         WHEN ftype = 'money' THEN greatest(0e0, 1e0 - abs(px - tx) / greatest(abs(tx), 1e0))
         WHEN outcome = 'TP' THEN 1e0
         WHEN ftype = 'text' THEN similarity ELSE 0e0 END) AS DOUBLE) AS score,
       round(1000e0 + r % 997, 1) AS latency_ms,
       CAST(printf('%.6f', (100 + r % 50) / 1000e0 * 0.00005e0 + (20 + r % 7) / 1000e0 * 0.0004e0) AS DOUBLE) AS cost_usd
FROM counted LEFT JOIN similarities s
  ON ftype = 'text' AND outcome = 'MISMATCH' AND p = lower(trim(ps)) AND t = lower(trim(ts))
WHERE error IS NULL AND outcome <> 'TN'
UNION ALL
SELECT model, effort, dataset, doc_id, '__error__', '', '', '', 'ERROR', 0e0, NULL, NULL
FROM doc_stats WHERE error IS NOT NULL""",
    "eval_doc_stats": BASE
    + """SELECT model, effort, dataset, doc_id, error, fields_correct, fields_total, exact_match
FROM doc_stats""",
    "eval_micro_macro": BASE
    + """SELECT model, effort, dataset, tp, fp, fn, micro_precision, micro_recall, micro_f1,
       round(macro_f1, 9) AS macro_f1 FROM micro_macro""",
    "eval_run_summary": BASE + "SELECT * FROM summary",
}
