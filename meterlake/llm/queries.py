"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import conversations, decontamination, langid, mixing, ogg, pst, sharding, simhash, suffix_dedup, token_count, token_files, variants, window_dedup


def queries() -> dict:
    return {
        "op1_token_count": token_count.op1_token_count,
        "op2_sharding": sharding.op2_sharding,
        "op3_mixing": mixing.op3_mixing,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_ogg_media": ogg.op6_ogg_media,
        "op7_language_model": pst.op7_language_model,
        "op8_language_id": langid.op8_language_id,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_window_dedup": window_dedup.op10_window_dedup,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op11_spelling_variants": variants.SQL, "op12_conversation_repair": conversations.SQL}
