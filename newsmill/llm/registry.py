"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from newsmill.llm import bpe, chunk_dedup, embedding_dedup, exact_dedup, line_dedup, ngram_quality, packing, quality_rules, secret_scan, simhash, sorted_shards, source_audit, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op4_secret_scan": secret_scan.query,
    "op2_simhash": simhash.query,
    "op3_ngram_quality": ngram_quality.query,
    "op5_sorted_shards": sorted_shards.query,
    "op6_quality_rules": quality_rules.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op7_chunk_dedup": chunk_dedup.query,
    "op9_packing": packing.query,
    "op8_byte_bpe": bpe.query,
    "op13_exact_dedup": exact_dedup.query,
    "op12_source_audit": source_audit.query,
    "op11_whitening": whitening.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
    "op12_source_audit": source_audit.SQL,
}
