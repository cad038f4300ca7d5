"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from kinweave.llm import bpe, decontamination, language, maximal, ngram_join, perspectives, quality, repair, repeats, sharding, simhash, templates, token_counts, whitening


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.query,
        "op2_sharding": sharding.query,
        "op3_token_counts": token_counts.query,
        "op4_line_dedup": templates.query,
        "op5_chat_perspectives": perspectives.query,
        "op6_suffix_array_dedup": repeats.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_quality_rules": quality.query,
        "op9_byte_bpe": bpe.query,
        "op10_language_id": language.query,
        "op11_ngram_jaccard": ngram_join.query,
        "op12_conversation_repair": repair.query,
        "op13_whitening": whitening.query,
        "maximal_repeats": maximal.query,
        "quality_ablation": quality.ablation_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL,
        "op5_chat_perspectives": perspectives.SQL,
        "op8_quality_rules": quality.QUERY_SQL,
        "op11_ngram_jaccard": ngram_join.SQL,
        "op12_conversation_repair": repair.SQL,
        "quality_ablation": quality.ABLATION_SQL,
    }
