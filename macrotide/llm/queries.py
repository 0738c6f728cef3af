"""The numbered queries and their oracle SQL."""

from __future__ import annotations

from macrotide.llm import audio, divergence, exact_dedup, fertility, hmm, html, mixing, ngram_join, packing, quality, resampling, substring_dedup, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_hmm_scores": hmm.op3_hmm_scores,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_signature_trees": ngram_join.op6_signature_trees,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_telephony_audio": audio.op8_telephony_audio,
    "op9_mixing": mixing.op9_mixing,
    "op10_ga_packing": packing.op10_ga_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_tokeniser_fertility": fertility.op12_tokeniser_fertility,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op9_mixing": mixing.OP9_SQL, "op11_source_divergence": divergence.OP11_SQL, "op13_importance_resampling": resampling.OP13_SQL}
