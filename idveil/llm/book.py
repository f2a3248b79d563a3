"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from idveil.llm import (
    exact_dedup,
    language_id,
    line_dedup,
    ngram_lm,
    packing,
    pieces,
    prefix_trie,
    quality_rules,
    secrets,
    shingle_join,
    spelling,
    toxicity,
    warc,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_jaccard": shingle_join.op4_ngram_jaccard,
    "op5_lm_scoring": ngram_lm.op5_lm_scoring,
    "op6_packing": packing.op6_packing,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_language_id": language_id.op12_language_id,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = {
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
