"""The registered queries of this subpackage and the SQL that checks them (none where SQL cannot express it)."""

from __future__ import annotations

from . import (
    chat_format,
    cover_tree,
    decontamination,
    lm_score,
    mixing,
    near_copies,
    prefix_trie,
    quality,
    secrets,
    sharding,
    substring_dedup,
    token_alignment,
    token_files,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_top_k": cover_tree.op2_top_k,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_secrets": secrets.op4_secrets,
    "op5_near_copies": near_copies.op5_near_copies,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_token_files": token_files.op10_token_files,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_top_k": cover_tree.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op5_near_copies": near_copies.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
