"""Fusion, rerank and bundles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import SOURCE_WEIGHTS
from kelpline.functions.text import preview
from kelpline.operators.matching import named_units
from kelpline.operators.storage import stash

ROUTES = ["dense", "sparse", "metadata", "safety"]
RECALL, QUALITY, SOURCE, LATER, JUDGE = 0.20, 0.10, 0.05, 0.5, 0.55


def all_hits(**routes: DataFrame) -> DataFrame:
    """One table of hits (query_id, unit_id, route, route_ord, pos, score, boost) of the routes by name."""
    out = None
    for name, hits in routes.items():
        boost = F.col("boost") if "boost" in hits.columns else F.lit(0.0)
        own = hits.select("query_id", "unit_id", F.lit(name).alias("route"), F.lit(ROUTES.index(name)).alias("route_ord"), "pos", F.col("score").cast("double").alias("score"), boost.alias("boost"))
        out = own if out is None else out.unionByName(own)
    return out


def fuse(hits: DataFrame, units: DataFrame, safety: str = "first") -> DataFrame:
    """query_id, unit_id, score, source, safety_boost, pos. In order of route and place the first hit of a unit counts by
    its weights and each later one by half its score; boosts are added. The safety boost and source are the first hit's
    (or with ``safety`` "any", any hit's boost). Hits without a unit count as candidates of quality .5."""
    order = W.partitionBy("query_id", "unit_id").orderBy("route_ord", "pos")
    hits = stash(hits)
    known = named_units(units, hits).select(F.col("id").alias("unit_id"), "quality_score", "source_status")
    weight = F.lit(0.0)
    for status, value in SOURCE_WEIGHTS.items():
        weight = F.when(F.coalesce("source_status", F.lit("candidate")) == status, value).otherwise(weight)
    turn = hits.withColumn("n", F.row_number().over(order))
    summed = turn.groupBy("query_id", "unit_id").agg(
        F.sum(F.col("score") * F.when(F.col("n") == 1, RECALL).otherwise(LATER) + F.col("boost")).alias("s"),
        F.min_by("route", "n").alias("source"),
        (F.min_by("boost", "n") if safety == "first" else F.max("boost")).alias("safety_boost"),
        F.min(F.struct("route_ord", "pos")).alias("seen"),
    )
    scored = summed.join(known, "unit_id", "left").withColumn("score", F.round(F.col("s") + F.coalesce("quality_score", F.lit(0.5)) * QUALITY + weight * SOURCE, 6))
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "seen.route_ord", "seen.pos", "unit_id")
    return scored.select("query_id", "unit_id", "score", "source", "safety_boost", F.row_number().over(rank).alias("pos"))


def rerank_requests(fused: DataFrame, units: DataFrame, queries: DataFrame, judged: int = 20) -> DataFrame:
    """query_id, query (300 characters), passages (200 characters each, in order) of the best ``judged``."""
    best = stash(fused.filter(F.col("pos") <= judged))
    best = best.join(named_units(units, best).select(F.col("id").alias("unit_id"), preview(F.col("text"), 200).alias("p")), "unit_id", "left")
    passages = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("p", F.lit("")).alias("p")))), lambda x: x["p"])
    return best.groupBy("query_id").agg(passages.alias("passages")).join(queries.select("query_id", preview(F.col("text"), 300).alias("query")), "query_id")


def rerank(fused: DataFrame, replies: DataFrame, judged: int = 20, top_k: int = 30) -> DataFrame:
    """Fused hits in a new order. With replies (query_id, scores by place, 0 to 10) the best ``judged`` gain JUDGE *
    score / 10 as far as scores go, and only they remain; a query without a reply keeps its best ``top_k``."""
    joined = fused.join(replies.select("query_id", "scores"), "query_id", "left")
    gained = F.coalesce(F.get("scores", F.col("pos") - 1), F.lit(0.0)) * JUDGE / 10
    kept = joined.filter((F.col("scores").isNotNull() & (F.col("pos") <= judged)) | (F.col("scores").isNull() & (F.col("pos") <= top_k)))
    scored = kept.withColumn("score", F.round(F.col("score") + F.when(F.col("scores").isNotNull(), gained).otherwise(0.0), 6)).withColumnRenamed("pos", "_old")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "_old")
    return scored.withColumn("pos", F.row_number().over(rank)).drop("_old", "scores")


def assemble_bundle(ranked: DataFrame, units: DataFrame, top_k_cards: int = 3, top_k_passages: int = 5) -> DataFrame:
    """query_id, bucket, bucket_rank, unit_id, score and fields of the unit. Quarantined units are excluded evidence,
    those with a safety boost safety evidence, candidates candidate evidence, all others supporting passages (the best
    ``top_k_passages``). Each unit is in its card bins as well (the best ``top_k_cards`` of a bin)."""
    fields = ["unit_type", "source_type", "source_status", "title", "semantic_tags", "scenario_tags", "card_targets"]
    ranked = stash(ranked)
    own = named_units(units, ranked).select(F.col("id").alias("unit_id"), *[c for c in fields if c in units.columns], preview(F.col("text"), 300).alias("snippet"))
    rows = ranked.join(own, "unit_id")
    status = F.when(F.col("source_status") == "quarantined", "excluded").when(F.col("safety_boost") > 0, "safety").when(F.col("source_status") == "candidate", "candidate").otherwise("supporting")
    bins = F.filter(F.array_distinct("card_targets"), lambda t: t.isin("mindfulness", "healing", "communication", "personalized"))
    placed = rows.withColumn("bucket", F.explode(F.concat(F.array(status), F.coalesce(bins, F.expr("cast(array() AS array<string>)")))))
    placed = placed.withColumn("bucket_rank", F.row_number().over(W.partitionBy("query_id", "bucket").orderBy("pos")))
    most = F.when(F.col("bucket") == "supporting", top_k_passages).when(F.col("bucket").isin("excluded", "safety", "candidate"), 2**31 - 1).otherwise(top_k_cards)
    return placed.filter(F.col("bucket_rank") <= most)


def route_debug(hits: DataFrame) -> DataFrame:
    """query_id and the number of hits of each route."""
    return hits.groupBy("query_id").pivot("route", ROUTES).count().na.fill(0, ROUTES)


def stage_debug(stages: Mapping[str, DataFrame], units: DataFrame) -> DataFrame:
    """query_id, stage, source_type, n: what each stage (tables with query_id and unit_id by name) has of each source type;
    a hit without a unit is unknown."""
    rows = [t.select("query_id", "unit_id", F.lit(name).alias("stage")) for name, t in stages.items()]
    known = units.select(F.col("id").alias("unit_id"), "source_type")
    joined = reduce(DataFrame.unionByName, rows).join(known, "unit_id", "left")
    return joined.groupBy("query_id", "stage", F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n"))
