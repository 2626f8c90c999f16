"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, fill_middle, language, mixing, near_dedup, quality_rules, resampling, secrets, substring_dedup, tokens, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_importance_resampling": resampling.op2_importance_resampling,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_bpe": bpe.op11_bpe,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op4_mixing": mixing.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
