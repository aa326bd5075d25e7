"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from glosswork.llm import ann, bpe, chat, exact_dedup, merkle, mixing, near_dedup, packing, phrases, quality, secrets, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_chat": chat.op3_chat,
    "op4_mixing": mixing.op4_mixing,
    "op5_ann": ann.op5_ann,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_url_filter": urls.op11_url_filter,
    "op12_merkle": merkle.op12_merkle,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op11_url_filter": urls.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
