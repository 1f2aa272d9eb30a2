"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tieweave.llm import chat, clustering, counts, decontaminate, langid, mixing, quality, search, secrets, simhash, suffix, tokens, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_langid": langid.op2_langid,
        "op3_tokens": tokens.op3_tokens,
        "op4_suffix": suffix.op4_suffix,
        "op5_mixing": mixing.op5_mixing,
        "op6_chat": chat.op6_chat,
        "op7_simhash": simhash.op7_simhash,
        "op8_quality": quality.op8_quality,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_secrets": secrets.op10_secrets,
        "op11_search": search.op11_search,
        "op12_clustering": clustering.op12_clustering,
        "op13_token_counts": counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.OP5_SQL, "op6_chat": chat.OP6_SQL, "op11_search": search.OP11_SQL, "op12_clustering": clustering.op12_sql()}
