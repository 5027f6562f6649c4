"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, kneser_ney, language_id, line_dedup, mixing, packing, piece_coding, repetition, secret_scan, spelling, url_filters, whitening

QUERIES = {
    "op1_pareto_mixing": mixing.query,
    "op2_differencing_packing": packing.query,
    "op3_winnowing_line_dedup": line_dedup.query,
    "op4_ftrl_language_id": language_id.query,
    "op5_bloom_cascade_urls": url_filters.query,
    "op6_blob_ledger_secrets": secret_scan.query,
    "op7_multi_order_jaccard": jaccard_join.query,
    "op8_streaming_exact_dedup": exact_dedup.query,
    "op9_kneser_ney_scores": kneser_ney.query,
    "op10_suffix_array_quality": repetition.query,
    "op11_kd_tree_spelling": spelling.query,
    "op12_agenda_piece_coding": piece_coding.query,
    "op13_spectral_whitening": whitening.query,
}

ORACLES = {
    "op1_pareto_mixing": mixing.ORACLE,
    "op3_winnowing_line_dedup": line_dedup.ORACLE,
    "op5_bloom_cascade_urls": url_filters.ORACLE,
    "op6_blob_ledger_secrets": secret_scan.ORACLE,
    "op7_multi_order_jaccard": jaccard_join.ORACLE,
    "op8_streaming_exact_dedup": exact_dedup.ORACLE,
    "op11_kd_tree_spelling": spelling.ORACLE,
}
