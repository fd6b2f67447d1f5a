"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from weftline.llm import byte_bpe, html_extraction, line_dedup, mixing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": topk_search.OP2_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
}
