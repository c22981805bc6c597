"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage
MODULES = {
    "op1_url_filter": "url_filter",
    "op2_packing": "packing",
    "op3_mixing": "mixing",
    "op4_embedding_dedup": "embedding_dedup",
    "op5_ngram_join": "ngram_join",
    "op6_licence_scan": "licence_scan",
    "op7_language_id": "language_id",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_pii": "pii",
    "op10_exact_dedup": "exact_dedup",
    "op11_quality_rules": "quality_rules",
    "op12_conversation_repair": "conversation_repair",
    "op13_conversation_trie": "conversation_trie",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"codonloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"codonloom.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
