"""The registered ``opN_<name>`` queries and the SQL that states them."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, lm_scoring, near_dedup, packing, quality_rules, substring_dedup, token_files, toxicity


def queries():
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_packing": packing.op5_packing,
        "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_token_files": token_files.op8_token_files,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality_rules.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op3_exact_dedup": exact_dedup.OP3_SQL,
    }
