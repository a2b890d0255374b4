"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sluice.llm import alignment, embedding_dedup, exact_dedup, html_text, mixing, pieces, sharding, simhash, substring_dedup, suffix_dedup, toxicity, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_jump_hash": sharding.op3_jump_hash,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_embeddings": embedding_dedup.op6_embeddings,
    "op7_html_text": html_text.op7_html_text,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_embeddings": embedding_dedup.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
}
