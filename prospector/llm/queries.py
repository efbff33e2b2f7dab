"""Queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from prospector.llm import chat, decontaminate, divergence, embeddings, lines, lm, mixing, quality, search, sharding, simhash, substring, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1,
    "op2_sharding": sharding.op2,
    "op3_embedding_near_dedup": embeddings.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_source_mixing": mixing.op5,
    "op6_toxicity": toxicity.op6,
    "op7_chat_formatting": chat.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_line_dedup": lines.op9,
    "op10_lm_scoring": lm.op10,
    "op11_ranked_search": search.op11,
    "op12_source_divergence": divergence.op12,
    "op13_quality_rules": quality.op13,
}

SQL = {
    "op5_source_mixing": mixing.OP5_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op11_ranked_search": search.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_quality_rules": quality.OP13_SQL,
}
