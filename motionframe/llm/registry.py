"""Queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from motionframe.llm import exact_dedup, near_dedup, packing, pieces, pii, suffix_dedup, token_output, topk_search, toxicity, url_filter

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_merge_dropout": pieces.op9_merge_dropout,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}

SQL = {
    "op2_near_dedup": near_dedup.SQL,
    "op6_topk_search": topk_search.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
}
