"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, importance, language_id, line_dedup, ngram_join, packing, pii, secret_scan, substring_dedup, topk_search, url_filter, vector_codes

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language_id.op4_language_id,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_packing": packing.op7_packing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_pii": pii.op11_pii,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op10_topk_search": topk_search.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
