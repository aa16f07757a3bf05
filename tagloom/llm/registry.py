"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import (
    byte_bpe,
    exact_topk,
    language_id,
    merkle_manifest,
    mixing,
    ogg,
    prefix_trie,
    quotation_linking,
    simhash_dedup,
    substring_dedup,
    suffix_array_dedup,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_mixing": mixing.query,
    "op3_exact_topk": exact_topk.query,
    "op4_language_id": language_id.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_quotation_linking": quotation_linking.query,
    "op7_toxicity": toxicity.query,
    "op8_ogg": ogg.query,
    "op9_suffix_array_dedup": suffix_array_dedup.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_token_counts": token_counts.query,
    "op13_merkle_manifest": merkle_manifest.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": exact_topk.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_quotation_linking": quotation_linking.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
