"""Registered queries of the training-data operators."""

from __future__ import annotations

from . import (
    decontamination, hard_negatives, language_id, mixing, packing, quality_rules, sharding, simhash, substring_dedup,
    suffix_dedup, surrogates, warc, whitening,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_sharding": sharding.op5_sharding,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_warc": warc.op8_warc,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_surrogates": surrogates.op10_surrogates,
    "op11_whitening": whitening.op11_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_packing": packing.op13_packing,
}
ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
