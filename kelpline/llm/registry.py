"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_dedup, html_text, language_id, mixing, ngram_join, packing, pattern_packing, prefix_trie, quality_rules, sharding, site_quality, substring_dedup, tiered_search,
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_packing": packing.query,
    "op3_sharding": sharding.query,
    "op4_site_quality": site_quality.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_language_id": language_id.query,
    "op7_quality_rules": quality_rules.query,
    "op8_mixing": mixing.query,
    "op9_html_text": html_text.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_pattern_packing": pattern_packing.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_tiered_search": tiered_search.query,
    "pipeline": _pipeline,
}
ORACLES = {"op8_mixing": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_tiered_search": tiered_search.SQL}
