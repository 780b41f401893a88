"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from gridloom.llm import chunks, class_lm, mixing, ngram_join, packing, suffixes, topk, toxicity, url_rules, vector_dedup

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_exact_topk": topk.query,
    "op3_ngram_jaccard": ngram_join.query,
    "op4_chunk_dedup": chunks.query,
    "op5_url_filter": url_rules.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_toxicity": toxicity.query,
    "op8_vector_dedup": vector_dedup.query,
    "op9_pack_lengths": packing.query,
    "op10_class_lm": class_lm.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_exact_topk": topk.ORACLE,
    "op3_ngram_jaccard": ngram_join.ORACLE,
    "op4_chunk_dedup": chunks.ORACLE,
    "op6_suffix_dedup": suffixes.ORACLE,
    "op8_vector_dedup": vector_dedup.ORACLE,
    "op9_pack_lengths": packing.ORACLE,
}
