"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import decontam, langid, linededup, mixing, pii, quality, quotes, rules, shards, simhash, trie, urls


def queries() -> dict:
    return {
        "op1_url_filter": urls.op1_url_filter,
        "op2_language_id": langid.op2_language_id,
        "op3_quality": quality.op3_quality,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_chat_quotes": quotes.op7_chat_quotes,
        "quoted_conversations": quotes.quoted_conversations,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_simhash": simhash.op9_simhash,
        "op10_pii": pii.op10_pii,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_sharding": shards.op12_sharding,
    }


def oracle_sql() -> dict:
    return {
        "op1_url_filter": urls.OP1_SQL,
        "op4_mix_sources": mixing.OP4_SQL,
        "op6_decontaminate": decontam.OP6_SQL,
        "op7_chat_quotes": quotes.OP7_SQL,
        "quoted_conversations": quotes.QUOTED_SQL,
        "op8_quality_rules": rules.OP8_SQL,
        "op11_prefix_trie": trie.OP11_SQL,
        "op12_sharding": shards.OP12_SQL,
    }
