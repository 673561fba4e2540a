"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewell.llm import chat, exact_dedup, language_id, licenses, line_dedup, mixing, near_dedup, pieces, quality, sharding


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_sharding": sharding.op5_sharding,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict:
    return {"op1_line_dedup": line_dedup.ORACLE, "op5_sharding": sharding.oracle(), "op7_exact_dedup": exact_dedup.ORACLE}
