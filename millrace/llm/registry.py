"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, divergence, langid, lexical, linededup, mixing, neardup, packing, pii, quality, suffixdedup, topk

QUERIES = {
    "op1_lm_score": mixing.op1_lm_score,
    "op2_chat_format": chat.op2_chat_format,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_bpe": bpe.op5_bpe,
    "op6_topk": topk.op6_topk,
    "op7_language_id": langid.op7_language_id,
    "op8_minhash": neardup.op8_minhash,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_suffix_dedup": suffixdedup.op12_suffix_dedup,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES = {
    "op2_chat_format": chat.SQL,
    "op6_topk": topk.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_suffix_dedup": suffixdedup.SQL,
    "op13_lexical_search": lexical.SQL,
}
