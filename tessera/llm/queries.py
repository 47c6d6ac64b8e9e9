"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, edit_fingerprints, exact_dedup, html_text, licences, line_dedup, mixing, near_dedup, neighbours, periodic, prefix_trie, quality, repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.query,
    "op2_html_text": html_text.query,
    "op3_quality_classifier": quality.query,
    "op4_nearest_neighbours": neighbours.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_line_dedup": line_dedup.query,
    "op7_bpe": bpe.query,
    "op8_licence_scan": licences.query,
    "op9_repeated_windows": repeats.query,
    "op10_near_dedup": near_dedup.query,
    "op11_periodic_runs": periodic.query,
    "op12_conversation_trie": prefix_trie.query,
    "op13_edit_fingerprints": edit_fingerprints.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_licence_scan": licences.ORACLE_SQL,
    "op12_conversation_trie": prefix_trie.ORACLE_SQL,
}
