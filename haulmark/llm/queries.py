"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from haulmark.llm import (
    conversation_trie,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language,
    line_dedup,
    merkle,
    packing,
    personal_data,
    piece_tokens,
    suffix_dedup,
    token_blocks,
    toxicity,
)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_language_id": language.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_blocks": token_blocks.op8_token_blocks,
    "op9_sentencepiece": piece_tokens.op9_sentencepiece,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
