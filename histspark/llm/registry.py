"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversation_repair, decontamination, exact_dedup, hard_negatives, jaccard_join, licenses, lm_scoring, packing, quality, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_packing": packing.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_sharding": sharding.query,
    "op4_quality": quality.query,
    "op5_lm_scoring": lm_scoring.query,
    "op9_jaccard_join": jaccard_join.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op8_toxicity": toxicity.query,
    "op7_decontamination": decontamination.query,
    "op10_licenses": licenses.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
