"""Retrieval metrics, summaries and ground truth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import TARGETS
from kelpline.functions.text import preview
from kelpline.operators.indexing import word_parts
from kelpline.operators.matching import named_units
from kelpline.operators.storage import stash

#: Buckets whose items are evaluated, in order.
ITEMS = ["supporting", "mindfulness", "healing", "communication", "personalized"]
#: What the hash of a run is multiplied by before the next word's is added, modulo 2 ** 64.
STEP = np.uint64(0x9E3779B97F4A7C15)


def _share(found: Column, expected: Column) -> Column:
    n = F.size(F.coalesce(expected, F.array()))
    return F.when(n > 0, F.size(F.array_intersect(found, expected)) / n).otherwise(1.0)


def recall_at_k(ids: Column, expected: Column, k: int = 10) -> Column:
    return _share(F.slice(ids, 1, k), expected)


def _run_hashes(batches: Iterator[pa.RecordBatch], key: str, size: int, asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``key`` and run, distinct within a slice of the batches: a 64-bit hash of each ``size`` words in a row of a text; only of
    runs that are ``asked`` (sorted) where these are given."""
    few = np.zeros(1 << 22, bool)  # by the last bits of a hash, so that few others are looked up
    if asked is not None:
        few[asked & np.uint64(len(few) - 1)] = True
    for part, row, code, words, _ in word_parts(batches):
        own = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words.to_pylist()], np.uint64)
        n = max(0, len(code) - size + 1)
        run, hashes = np.zeros(n, np.uint64), own[code]
        for j in range(size):
            run = run * STEP + hashes[j : j + n]
        inside = row[:n] == row[size - 1 : size - 1 + n]
        if asked is not None:
            inside &= few[run & np.uint64(len(few) - 1)]
        at = np.flatnonzero(inside)
        if asked is not None and len(asked):
            at = at[asked[np.minimum(np.searchsorted(asked, run[at]), len(asked) - 1)] == run[at]]
        at = at[np.lexsort((run[at], row[at]))]
        at = at[(np.diff(row[at], prepend=-1) != 0) | (np.diff(run[at], prepend=np.uint64(0)) != 0)]
        yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row[at])), pa.array(run[at].view(np.int64))], [key, "run"])


def _runs(rows: DataFrame, key: str, size: int, asked: np.ndarray | None = None) -> DataFrame:
    """key, run: a hash of each ``size`` words in a row of the text; all of them, or the ``asked``."""
    texts = rows.select(key, F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(lambda b: _run_hashes(b, key, size, asked), f"{key} {rows.schema[key].dataType.simpleString()}, run long")


def passages_in_units(requests: DataFrame, units: DataFrame, size: int = 8, most_broadcast: int = 1 << 20) -> DataFrame:
    """query_id, must_include_ids: the units, by id, that share ``size`` words in a row with the text of a request; of requests
    that have any. Runs of words meet by their hashes; while the requests have at most ``most_broadcast`` of them, all other
    runs of units end where texts are read."""
    asked = stash(_runs(requests, "query_id", size))
    few = asked.count() <= most_broadcast
    wanted = np.unique(asked.select("run").distinct().toArrow()["run"].to_numpy().view(np.uint64)) if few else None
    found = _runs(units, "id", size, wanted).join(F.broadcast(asked) if few else asked, "run").select("query_id", "id").distinct()
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("must_include_ids"))


def evaluate(bundle: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A row for each query (query_id, scenario, risk_level, must_include_ids, expected_tags, must_include_source_types,
    must_include_card_targets, must_not_include_flags) with the seven metrics. Items are those of ITEMS in order, with
    repeats; a query without a bundle has no items."""
    order = F.array_position(F.array(*[F.lit(b) for b in ITEMS]), F.col("bucket"))
    item = F.struct(order.alias("o"), "bucket_rank", "unit_id", "source_type", "source_status", "semantic_tags", "scenario_tags", "card_targets")
    grouped = bundle.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("bucket").isin(ITEMS), item))).alias("items"),
        F.count_if(F.col("bucket") == "safety").alias("n_safety"),
        F.count_if((F.col("bucket") == "excluded") & (F.col("source_status") == "quarantined")).alias("n_quarantined"),
    )
    rows = queries.join(grouped, "query_id", "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    empty = F.expr("cast(array() AS array<string>)")
    of = lambda field: F.coalesce(F.col(f"items.{field}"), empty)
    flat = lambda field: F.flatten(F.transform(of_array(field), lambda a: F.coalesce(a, empty)))
    of_array = lambda field: F.coalesce(F.col(f"items.{field}"), F.expr("cast(array() AS array<array<string>>)"))
    tags = F.array_distinct(F.concat(flat("semantic_tags"), flat("scenario_tags")))
    forbidden = F.coalesce("must_not_include_flags", empty)
    violations = F.size(F.filter(of("source_status"), lambda s: F.array_contains(forbidden, s)))
    metrics = {
        "recall_at_10": recall_at_k(of("unit_id"), F.col("must_include_ids"), k),
        "safety_hit": (~F.coalesce(F.col("risk_level").isin("high", "medium"), F.lit(False)) | (F.coalesce("n_safety", F.lit(0)) > 0)).cast("double"),
        "noise_rate": F.when(n > 0, F.col("n_quarantined") / n).otherwise(0.0),
        "tag_match": _share(tags, F.col("expected_tags")),
        "source_type_match": _share(F.array_distinct(of("source_type")), F.col("must_include_source_types")),
        "flag_check": F.greatest(F.lit(0.0), 1.0 - violations / F.greatest(n, F.lit(1))),
        "card_target_match": _share(F.array_distinct(flat("card_targets")), F.col("must_include_card_targets")),
    }
    return rows.select("query_id", "scenario", "risk_level", n.alias("n_items"), *[F.round(c, 6).alias(name) for name, c in metrics.items()])


def evaluate_summary(details: DataFrame) -> DataFrame:
    """One row of means over all queries; a failed one (null metrics) counts 0."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    return details.agg(
        F.count("*").alias("total_queries"), mean("recall_at_10").alias("recall_at_10"), mean("safety_hit").alias("safety_hit_rate"), mean("noise_rate").alias("noise_rate"),
        mean("tag_match").alias("avg_tag_match"), mean("source_type_match").alias("avg_source_type_match"), mean("flag_check").alias("avg_flag_check"), mean("card_target_match").alias("avg_card_target_match"),
    )


def append_run(summary: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append the summary row to the run history below ``path`` with its id and time, and return the history."""
    summary.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("run_at"), "*").write.mode("append").parquet(path)
    return summary.sparkSession.read.parquet(path)


def evaluate_by_scenario(details: DataFrame) -> DataFrame:
    """Means by scenario, failed queries left out."""
    return details.filter("recall_at_10 IS NOT NULL").groupBy("scenario").agg(
        F.count("*").alias("count"), F.round(F.avg("recall_at_10"), 4).alias("avg_recall"), F.round(F.avg("safety_hit"), 4).alias("avg_safety"), F.round(F.avg("source_type_match"), 4).alias("avg_source_type")
    )


def compare_targets(summary: DataFrame, targets: Mapping[str, tuple[str, float] | None] = TARGETS) -> DataFrame:
    """metric, value, target, status (PASS, FAIL, or - where there is no target)."""
    long = summary.unpivot([], [F.col(m).cast("double").alias(m) for m in targets], "metric", "value")
    target, passed = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for metric, t in targets.items():
        if t:
            target = F.when(F.col("metric") == metric, t[1]).otherwise(target)
            passed = F.when(F.col("metric") == metric, F.col("value") >= t[1] if t[0] == ">=" else F.col("value") <= t[1]).otherwise(passed)
    return long.select("metric", "value", target.alias("target"), F.when(passed, "PASS").when(~passed, "FAIL").otherwise("-").alias("status"))


def discover_ground_truth(dense: DataFrame, sparse: DataFrame, units: DataFrame, top_dense: int = 20, top_sparse: int = 15, top: int = 15) -> DataFrame:
    """query_id, rank, unit_id, score, sources, text_preview: candidates for judging from two routes' hits."""
    d = dense.filter(F.col("pos") <= top_dense).select("query_id", "unit_id", F.col("score").alias("d"))
    s = sparse.filter(F.col("pos") <= top_sparse).select("query_id", "unit_id", F.col("score").alias("s"))
    both = d.join(s, ["query_id", "unit_id"], "full_outer")
    sources = F.concat_ws("+", F.when(F.col("d").isNotNull(), "dense"), F.when(F.col("s").isNotNull(), "sparse"))
    scored = both.select("query_id", "unit_id", F.round(F.greatest("d", "s") + 1e-9, 4).alias("score"), sources.alias("sources"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))).filter(F.col("rank") <= top)
    ranked = stash(ranked)
    return ranked.join(named_units(units, ranked).select(F.col("id").alias("unit_id"), preview(F.col("text"), 300).alias("text_preview")), "unit_id").select("query_id", "rank", "unit_id", "score", "sources", "text_preview")


def apply_ground_truth(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries with must_include_ids replaced by the ids (query_id, rank, unit_id, relevance_note) noted relevant, in
    order of rank, where there are any."""
    good = judged.filter(F.lower(F.trim("relevance_note")) == "relevant").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "unit_id"))).alias("g"))
    joined = queries.join(good, "query_id", "left")
    return joined.withColumn("must_include_ids", F.coalesce(F.col("g.unit_id"), F.col("must_include_ids"))).drop("g")
