"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from qamill.llm import (collocations, conversation_repair, decontamination, embedding_dedup, html_extraction, language_id, packing, quality,
                        sharding, simhash_dedup, token_store, toxicity, url_filters)

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_toxicity": toxicity.query,
    "op3_best_fit_packing": packing.query,
    "op4_url_filters": url_filters.query,
    "op5_benchmark_decontamination": decontamination.query,
    "op6_quality_classifier": quality.query,
    "op7_language_id": language_id.query,
    "op8_sharding": sharding.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_collocations": collocations.query,
    "op12_token_store": token_store.query,
    "op13_conversation_repair": conversation_repair.query,
}

ORACLE = {
    "op4_url_filters": url_filters.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
