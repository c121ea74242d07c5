"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from driftline.llm import (
    language_id, merkle_manifest, minhash_dedup, packing, periodic_runs, piece_codec, quality_rules, secret_scan, simhash_dedup, suffix_dedup, token_file, topk_search, toxicity,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MODULES = (
    minhash_dedup, language_id, suffix_dedup, secret_scan, packing, piece_codec, token_file, topk_search, quality_rules, toxicity, periodic_runs, merkle_manifest, simhash_dedup,
)

for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE |= getattr(module, "ORACLE", {})
