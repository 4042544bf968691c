"""Registered corpus queries and their SQL twins."""
from __future__ import annotations

from glyphmill.llm import bpe, chat, decontaminate, exact_dedup, lexical, near_dedup, negatives, packing, pii, quality, secrets, sharding, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_pii": pii.op5_pii,
    "op6_chat_format": chat.op6_chat_format,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_lexical": lexical.op12_lexical,
    "op13_bpe": bpe.op13_bpe,
}
ORACLES = {
    "op6_chat_format": chat.ORACLE,
    "op1_near_dedup": near_dedup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_lexical": lexical.ORACLE,
}
