"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from lodegraph.llm import ann, decontaminate, langid, licenses, line_dedup, near_dup, packing, pieces, quality, records, spelling, toxicity, whiten

QUERIES = {
    "op1_multi_index_hashing": ann.query,
    "op2_simhash_decontamination": decontaminate.query,
    "op3_language_mixture": langid.query,
    "op4_fuzzy_line_dedup": line_dedup.query,
    "op5_record_files": records.query,
    "op6_shortest_pack_first": packing.query,
    "op7_minhash_near_dedup": near_dup.query,
    "op8_ftrl_toxicity": toxicity.query,
    "op9_positive_unlabelled": quality.query,
    "op10_license_join": licenses.query,
    "op11_spelling_variants": spelling.query,
    "op12_sentencepiece": pieces.query,
    "op13_whitening": whiten.query,
}

#: Where SQL has no equal on whole tables there is none; tests/llm compares with brute force.
ORACLES: dict[str, str] = {"op11_spelling_variants": spelling.ORACLE}
