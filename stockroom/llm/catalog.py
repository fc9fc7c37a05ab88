"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from stockroom.llm import bounded_ring, centroid_clusters, decontamination, html_text, language_id, license_scan, near_duplicates, quality_rules, recurrent_lm, source_mix, spelling_variants, token_files, toxicity

QUERIES = {
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op1_decontamination": decontamination.op1_decontamination,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_html_text": html_text.op6_html_text,
    "op7_recurrent_lm": recurrent_lm.op7_recurrent_lm,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op8_token_files": token_files.op8_token_files,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_centroid_clusters": centroid_clusters.op12_centroid_clusters,
    "op13_bounded_ring": bounded_ring.op13_bounded_ring,
}

ORACLE = {
    "op5_source_mix": source_mix.OP5_SQL,
    "op12_centroid_clusters": centroid_clusters.OP12_SQL,
}
