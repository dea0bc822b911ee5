"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, packing, sharding, token_align, topk_search, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_align": token_align.op12_token_align,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sharding": sharding.op8_sharding,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
}

ORACLES = {
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_topk_search": topk_search.ORACLE_SQL,
    "op3_chat_format": chat_format.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
}
