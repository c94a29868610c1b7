"""The whole retrieval of a table of requests (R12): recall by four routes, fusion, rerank and bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.lexicon import SAFETY_RULES
from kelpline.operators import fusion, recall
from kelpline.operators.indexing import MAX_FEATURES, gram_vectors


def gram_recall(rewrites: DataFrame, index: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """The dense route over the gram vectors of an index, for rewrites (query_id, rewrite_no, text)."""
    key = F.struct("query_id", F.col("rewrite_no").cast("int").alias("rewrite_no"))
    asked = gram_vectors(rewrites.select(key.alias("id"), "text"), index["vocabulary"])
    asked = asked.select(F.col("id.query_id").alias("query_id"), F.col("id.rewrite_no").alias("rewrite_no"), "at", "weight")
    return recall.sparse_dot_recall(asked, index["vectors"], MAX_FEATURES, k)


def recall_hits(
    queries: DataFrame,
    units: DataFrame,
    index: Mapping[str, DataFrame],
    rules: Mapping[str, Sequence[str]] = SAFETY_RULES,
    routes: Sequence[str] = tuple(fusion.ROUTES),
    op: str = "and",
) -> DataFrame:
    """Hits of the ``routes`` for prepared queries (query_id, rewritten_queries, scenario_tags, role_focus, risk_signals,
    contraindication_signals): query_id, unit_id, route, route_ord, pos, score, boost."""
    rewrites = recall.rewrites(queries)
    ways = {
        "dense": lambda: gram_recall(rewrites, index),
        "sparse": lambda: recall.bm25_recall(rewrites, index["postings"], index["stats"], op=op),
        "metadata": lambda: recall.metadata_recall(queries, units),
        "safety": lambda: recall.safety_recall(queries, units, rules),
    }
    return fusion.all_hits(**{name: ways[name]() for name in fusion.ROUTES if name in routes})


def retrieve(
    requests: DataFrame,
    analyses: DataFrame,
    units: DataFrame,
    index: Mapping[str, DataFrame],
    replies: DataFrame,
    rules: Mapping[str, Sequence[str]] = SAFETY_RULES,
    routes: Sequence[str] = tuple(fusion.ROUTES),
    op: str = "and",
    top_k_cards: int = 3,
    top_k_passages: int = 5,
) -> DataFrame:
    """Evidence bundles of all ``requests`` (query_id, patient_text): their ``analyses`` are joined, the ``routes`` recall
    units by an index (``index_store.open_index``, or ``indexing.build_index``), hits are fused, re-ranked by ``replies`` (query_id, scores; a query
    without any keeps its order) and laid out in buckets."""
    queries = recall.prepare_queries(requests, analyses)
    fused = fusion.fuse(recall_hits(queries, units, index, rules, routes, op), units)
    return fusion.assemble_bundle(fusion.rerank(fused, replies), units, top_k_cards, top_k_passages)
