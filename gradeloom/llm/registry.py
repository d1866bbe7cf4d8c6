"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from gradeloom.llm import bpe_chunks, exact_topk, html_wrapper, line_dedup, mixing, near_dedup, pu_quality, quality_rules, toxicity, url_filter

QUERIES = {
    "op1_html_wrapper": html_wrapper.op1_html_wrapper,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe_chunks": bpe_chunks.op5_bpe_chunks,
    "op6_pu_quality": pu_quality.op6_pu_quality,
    "op7_exact_topk": exact_topk.op7_exact_topk,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES = {
    "op2_url_filters": url_filter.OP2_SQL,
    "op7_exact_topk": exact_topk.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
