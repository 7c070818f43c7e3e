"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import base_columns, collocations, conversations, decontamination, extraction, language, licenses, near_duplicates, packing, repetition, secrets, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_packing": packing.op2_packing,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard_join": near_duplicates.op5_jaccard_join,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_language": language.op9_language,
    "op10_extraction": extraction.op10_extraction,
    "op11_secrets": secrets.op11_secrets,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_collocations": collocations.op13_collocations,
    **base_columns.QUERIES,
}

ORACLE_SQL = {**base_columns.ORACLE, **collocations.ORACLE, **conversations.ORACLE, **decontamination.ORACLE, **near_duplicates.ORACLE, **substring_dedup.ORACLE, **suffix_dedup.ORACLE}
