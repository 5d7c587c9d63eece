"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from sextant.llm import bpe, chat, decontaminate, language, line_dedup, lm_score, quality, sharding, simhash, token_count

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_chat_format": chat.op3_chat_format,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_count": token_count.op5_token_count,
    "op6_quality": quality.op6_quality,
    "op7_language": language.op7_language,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_shard": sharding.op9_shard,
    "op10_lm_score": lm_score.op10_lm_score,
}

ORACLES = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op3_chat_format": chat.ORACLE_SQL}
