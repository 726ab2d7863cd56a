"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, html_extract, media, mixing, near_dedup, packing, pii, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_html_extraction": html_extract.op1,
    "op2_minhash_near_dedup": near_dedup.op2,
    "op3_source_mixing": mixing.op3,
    "op4_nnls_packing": packing.op4,
    "op5_substring_dedup": substring_dedup.op5,
    "op6_toxicity": toxicity.op6,
    "op7_matroska": media.op7,
    "op8_token_files": token_files.op8,
    "op9_pii": pii.op9,
    "op10_embedding_near_dedup": embedding_dedup.op10,
}

#: None: every one of the ten holds a step (parsing, hashing to fixed seeds, trained trees, tokenizers, iteration to a
#: fixed point) that SQL can't state or that is too slow over whole tables; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {}
