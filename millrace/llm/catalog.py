"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm import alignment, bpe, decontamination, filter_audit, line_dedup, lm_scoring, near_join, quality, rule_ensemble, secrets, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_winnow_line_dedup": line_dedup.op1_winnow_line_dedup,
    "op1_content_line_dedup": line_dedup.op1_content_line_dedup,
    "op2_hash_tree_sharding": sharding.op2_hash_tree_sharding,
    "op3_secret_ledger": secrets.op3_secret_ledger,
    "op4_fm_substring_dedup": substring_dedup.op4_fm_substring_dedup,
    "op5_bpe_word_table": bpe.op5_bpe_word_table,
    "op6_cgk_decontamination": decontamination.op6_cgk_decontamination,
    "op7_pseudo_likelihood": lm_scoring.op7_pseudo_likelihood,
    "op8_chosen_path_join": near_join.op8_chosen_path_join,
    "op9_viterbi_token_counts": token_counts.op9_viterbi_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_stabbing_alignment": alignment.op12_stabbing_alignment,
    "op13_rule_ensemble": rule_ensemble.op13_rule_ensemble,
}

ORACLES: dict[str, str] = {
    "op1_winnow_line_dedup": line_dedup.OP1_SQL,
    "op1_content_line_dedup": line_dedup.OP1_CONTENT_SQL,
    "op2_hash_tree_sharding": sharding.OP2_SQL,
    "op3_secret_ledger": secrets.OP3_SQL,
    "op4_fm_substring_dedup": substring_dedup.OP4_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
