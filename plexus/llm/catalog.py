"""The queries of this package and their SQL."""

from __future__ import annotations

from plexus.llm import align, bpe, chat, decontam, dedup, flac, langid, mixing, near, sharding, toxicity, whiten, wordpiece

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": dedup.op2_exact_dedup,
    "op3_chat": chat.op3_chat,
    "op4_token_counts": wordpiece.op4_token_counts,
    "op5_mixing": mixing.op5_mixing,
    "op6_sharding": sharding.op6_sharding,
    "op7_flac": flac.op7_flac,
    "op8_near_dedup": near.op8_near_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_language": langid.op10_language,
    "op11_decontamination": decontam.op11_decontamination,
    "op12_alignment": align.op12_alignment,
    "op13_whitening": whiten.op13_whitening,
}
ORACLES = {"op2_exact_dedup": dedup.ORACLE, "op3_chat": chat.ORACLE, "op11_decontamination": decontam.ORACLE}
