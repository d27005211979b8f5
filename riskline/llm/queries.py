"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from riskline.llm import alignment, dialogue, fingerprint, licenses, mixing, near, packing, passages, pii, quality, repeats, resample, sharding

QUERIES = {
    "op1_jaccard_join": near.op1_jaccard_join,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_suffix_dedup": repeats.op5_suffix_dedup,
    "op6_importance_resampling": resample.op6_importance_resampling,
    "op7_quality_ledger": quality.op7_quality_ledger,
    "op8_merkle_fingerprints": fingerprint.op8_merkle_fingerprints,
    "op9_histogram_shards": sharding.op9_histogram_shards,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op11_suffix_tree_dedup": passages.op11_suffix_tree_dedup,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_conversation_repair": dialogue.op13_conversation_repair,
}

ORACLE = {
    "op2_source_mix": mixing.OP2_SQL,
    "op7_quality_ledger": quality.OP7_SQL,
}
