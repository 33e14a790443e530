"""Every registered query, and the DuckDB statement it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldledger.plans import (
    benchmarks,
    envelopes,
    evaluation,
    filings,
    oracle_benchmarks,
    oracle_eval,
    oracle_more,
    oracle_prep,
    oracle_texts,
    receipts,
    reports,
    texts,
    tracking,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "eval_field_stats": evaluation.eval_field_stats,
    "eval_field_outcomes": evaluation.eval_field_outcomes,
    "eval_doc_stats": evaluation.eval_doc_stats,
    "eval_micro_macro": evaluation.eval_micro_macro,
    "eval_run_summary": evaluation.eval_run_summary,
    "parse_money_styles": receipts.parse_money_styles,
    "parse_date_formats": receipts.parse_date_formats,
    "clean_text_docs": receipts.clean_text_docs,
    "currency_cik_norm": receipts.currency_cik_norm,
    "normalize_receipts_flat": receipts.normalize_receipts_flat,
    "normalize_receipts_menu": receipts.normalize_receipts_menu,
    "prepared_receipts": receipts.prepared_receipts,
    "first_flat_receipts": receipts.first_flat_receipts,
    "row_positions": receipts.row_positions,
    "round_exact_large": receipts.round_exact_large,
    "sections": texts.section_rows,
    "sections_lookup": texts.sections_lookup,
    "filing_requests": texts.filing_requests,
    "document_requests": texts.document_requests,
    "html_to_text": texts.html_to_text,
    "admit_documents": texts.admit_documents,
    "route_documents": texts.route_documents,
    "ft_rows": texts.ft_rows,
    "ft_split_sizes": texts.ft_split_sizes,
    "ft_sink_roundtrip": texts.ft_sink_roundtrip,
    "text_similarity": texts.text_similarity,
    "infer_partitions": texts.infer_partitions,
    "validate_invoices": envelopes.validate_invoices,
    "validate_rejects": envelopes.validate_rejects,
    "flatten_invoices": envelopes.flatten_invoices,
    "selfcheck_f1": envelopes.selfcheck_f1,
    "call_metrics": envelopes.call_metrics,
    "xbrl_financials": filings.xbrl_financials,
    "nested_facts_readback": filings.nested_facts_readback,
    "latest_filing": filings.latest_filing,
    "filing_sidecars": filings.filing_sidecars,
    "resolve_tickers": filings.resolve_tickers,
    "filing_ground_truth": filings.filing_ground_truth,
    "multi_model_rollup": reports.multi_model_rollup,
    "base_vs_tuned": reports.base_vs_tuned,
    "matrix_missing": reports.matrix_missing,
    "run_matrix": reports.run_matrix,
    "report_field_table": reports.report_field_table,
    "job_progress": tracking.job_progress,
    "job_snapshot": tracking.job_snapshot,
    "stage_timing": tracking.stage_timing,
    "job_progress_stream": tracking.job_progress_stream,
    "stage_timing_stream": tracking.stage_timing_stream,
    "incremental_scores": tracking.incremental_scores,
    **benchmarks.QUERIES,
}

ORACLES: dict[str, str] = {
    **oracle_eval.STATEMENTS,
    **oracle_prep.STATEMENTS,
    **oracle_texts.STATEMENTS,
    **oracle_more.STATEMENTS,
    **oracle_benchmarks.STATEMENTS,
}
