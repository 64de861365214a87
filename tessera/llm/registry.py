"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import jaccard_join, mixing, packing, pii, quality_rules, secrets, tokens, toxicity, url_rules, vector_dedup

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_kneser_ney_toxicity": toxicity.op2_kneser_ney_toxicity,
    "op3_cube_mixing": mixing.op3_cube_mixing,
    "op4_boosted_pii": pii.op4_boosted_pii,
    "op5_length_histogram": tokens.op5_length_histogram,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_crf_secrets": secrets.op7_crf_secrets,
    "op8_link_graph_urls": url_rules.op8_link_graph_urls,
    "op9_product_quantisation": vector_dedup.op9_product_quantisation,
    "op10_size_aware_jaccard": jaccard_join.op10_size_aware_jaccard,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op8_link_graph_urls": url_rules.ORACLE_SQL,
    "op9_product_quantisation": vector_dedup.ORACLE_SQL,
    "op10_size_aware_jaccard": jaccard_join.ORACLE_SQL,
}
