"""Queries of this subpackage and the SQL that states them, by name."""

from __future__ import annotations

from tidewheel.llm import alignment, divergence, exact_dedup, langid, media, minhash, packing, pieces, simhash, substrings, token_files, toxicity, warc

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_files": token_files.op5_token_files,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_media_columns": media.op7_media_columns,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_warc": warc.op10_warc,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_simhash_dedup": simhash.op12_simhash_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_minhash_dedup": minhash.OP1_SQL,
    "op2_substring_dedup": substrings.OP2_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
