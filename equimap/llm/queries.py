"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import block_naming, chat_format, divergence, importance, jaccard_join, kneser_ney, language_id, mixing, personal_data, secret_scan, token_counts, url_filter, winnowing

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_exact_dedup": block_naming.op2_exact_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_temperature_mix": mixing.op6_temperature_mix,
    "op7_decontaminate": winnowing.op7_decontaminate,
    "op8_quality_perplexity": kneser_ney.op8_quality_perplexity,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_language_id": language_id.op10_language_id,
    "op11_importance_resample": importance.op11_importance_resample,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLE_SQL = {
    "op2_exact_dedup": block_naming.SQL,
    "op4_chat_format": chat_format.SQL,
    "op7_decontaminate": winnowing.SQL,
    "op9_url_filter": url_filter.SQL,
    "op11_importance_resample": importance.SQL,
    "op12_source_divergence": divergence.SQL,
}
