"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from tidepool.llm import bpe, exact_dedup, infill, langid, packing, ppm, quality, rules, secrets, simhash, spelling, substrings, votes

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality": quality.op2_quality,
    "op3_language": langid.op3_language,
    "op4_lm_score": ppm.op4_lm_score,
    "op5_secrets": secrets.op5_secrets,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_substrings": substrings.op8_substrings,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_infill": infill.op11_infill,
    "op12_spelling": spelling.op12_spelling,
    "op13_fingerprints": votes.op13_fingerprints,
}
ORACLES = {
    "op8_substrings": substrings.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_infill": infill.OP11_SQL,
}
