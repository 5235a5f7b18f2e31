"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from tidemark.llm import bpe, chat, decontaminate, licenses, line_dedup, ngram_join, token_ledger, token_store, toxicity, vector_search

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_ngram_join": ngram_join.query,
    "op3_license_scan": licenses.query,
    "op4_chat_rotation": chat.query,
    "op5_bpe": bpe.query,
    "op6_decontamination": decontaminate.query,
    "op7_exact_top_k": vector_search.query,
    "op8_token_counts": token_ledger.query,
    "op9_toxicity": toxicity.query,
    "op10_token_files": token_store.query,
}

#: Operators 5, 8, 9 and 10 are learned or need a tokenizer: their tests hold them against plain versions and libraries.
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_ngram_join": ngram_join.SQL,
    "op3_license_scan": licenses.SQL,
    "op4_chat_rotation": chat.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op7_exact_top_k": vector_search.SQL,
}
