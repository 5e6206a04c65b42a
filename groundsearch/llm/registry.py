"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from groundsearch.llm import chat_format, exact_dedup, mixing, near_dedup, packing, quality_rules, sharding, span_dedup, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_span_dedup": span_dedup.op7_span_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
