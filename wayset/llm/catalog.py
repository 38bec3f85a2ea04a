"""Names, queries and SQL of the corpus operators."""

from __future__ import annotations

from . import fingerprints, language_id, lm_scoring, mixing, near_dedup, packing, periodic_runs, prefix_trie, quality_knn, quality_rules, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_files": token_files.op4_token_files,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "quality_ablation": quality_rules.quality_ablation,
    "op10_quality_knn": quality_knn.op10_quality_knn,
    "op11_lm_scoring": lm_scoring.op11_lm_scoring,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op3_mixing": mixing.oracle(),
    "op8_quality_rules": quality_rules.oracle(),
    "quality_ablation": quality_rules.ablation_oracle(),
    "op12_periodic_runs": periodic_runs.oracle(),
    "op13_prefix_trie": prefix_trie.oracle(),
}
