"""Exact duplicates by sorting contents: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stash, table, text_of, without_spaces

#: Characters of the normalised text that a splitter may carry; beyond them its digest decides.
HEAD = 48
#: Rows of a range, sampled keys for each range, and the most ranges: they bound what the driver gets
#: (MOST_RANGES * SAMPLED keys of under 300 bytes).
RANGE_ROWS, SAMPLED, MOST_RANGES = 200_000, 12, 16_384


def _keyed(docs: DataFrame) -> DataFrame:
    """id, n_chars, normalised text, its digest and sort key, of the rows of ``docs`` (doc_id, text); equal texts have equal
    keys. The tie spreads equal keys."""
    norm = docs.select(F.col("doc_id").alias("id"), F.length(text_of()).alias("n_chars"), without_spaces(text_of()).alias("norm"))
    sha = norm.withColumn("sha", F.sha2("norm", 256))
    return _with_tie(sha.withColumn("sort_key", F.concat(F.substring("norm", 1, HEAD), F.lit("\x00"), "sha")))


def _with_tie(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("tied_key", F.concat("sort_key", F.lpad(F.hex(F.xxhash64("id", "n_chars")), 16, "0")))


def _splitters(docs: DataFrame, rows: int, ranges: int) -> list[str]:
    sampled = docs.select("doc_id", "text").sample(fraction=min(1.0, SAMPLED * ranges / max(1, rows)), seed=7)
    keys = sorted(x["tied_key"].encode() for x in _keyed(sampled).select("tied_key").collect())
    return sorted({keys[len(keys) * k // ranges].decode() for k in range(1, ranges)}, key=str.encode) if keys else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most the key, by bisection."""
    if not splitters:
        return F.lit(0)
    at = F.lit(splitters)

    def step(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = (span["low"] < span["high"]) & (F.get(at, middle) <= key)
        return F.struct(
            F.when(below, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(below | (span["low"] >= span["high"]), span["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length() + 1)), start, step)["low"]


def _sorted_runs(keyed: DataFrame, docs: DataFrame, *kept: str) -> DataFrame:
    """The rows of ``keyed`` (n_chars, sha, sort_key, tied_key and the columns ``kept``, with the normalised text as norm or
    the row that has it), sorted within ranges of content: range, place, run (of equal texts in the range, the one that
    stays first), first_of_run, and at the range's first and last row the normalised text as edge. ``docs`` are the rows
    that splitters are sampled from."""
    spark = docs.sparkSession
    rows = docs.count()
    ranges = min(MOST_RANGES, max(4 * partitions(spark), -(-rows // RANGE_ROWS)))
    dealt = keyed.withColumn("range", _range_of(F.col("tied_key"), _splitters(docs, rows, ranges))).drop("tied_key").repartition(partitions(spark), "range")
    dealt = dealt if "norm" in dealt.columns else dealt.withColumn("norm", without_spaces(text_of("row.text")))
    in_order = W.partitionBy("range").orderBy("sort_key", "norm", F.desc("n_chars"), F.asc_nulls_last("id"))
    first, last = F.lag("sort_key").over(in_order).isNull(), F.lead("sort_key").over(in_order).isNull()
    new = first | (F.lag("norm").over(in_order) != F.col("norm"))
    return (
        dealt.withColumns({"new": new, "end": first | last, "place": F.row_number().over(in_order)})
        .withColumn("run", F.sum(F.col("new").cast("long")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select(*kept, "id", "n_chars", "sha", "range", "place", "run", F.col("new").alias("first_of_run"), F.when(F.col("end"), F.col("norm")).alias("edge"))
    )


def _best() -> Column:
    """The order in which rows of a group stay."""
    return F.struct((-F.col("n_chars")).alias("fewer"), F.col("id").isNull().alias("no_id"), "id", "range", "place")


def content_sort(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of SPACES; null counts as empty. Of equal texts the
    row with the most code points stays, then the smallest id (a null id comes last), then any one of repeated rows.

    Sampled splitters deal rows to ranges; a range is sorted by content, and each text is compared in full with its
    neighbour. A large group of copies is cut into several ranges by a tie in the key: its runs touch the edges of
    their ranges and are joined there, again by full comparison. Texts are shuffled once.
    """
    slim = stash(_sorted_runs(_keyed(docs), docs).drop("first_of_run"))
    runs = slim.groupBy("range", "run").agg(F.min(_best()).alias("best"), F.count("*").alias("n"), F.max("edge").alias("edge"))
    runs = stash(runs)
    # A run at an edge may go on in the next range. There are two such runs in a range at most; the others are whole.
    joined = runs.filter("edge IS NOT NULL").groupBy("edge").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    whole = runs.filter("edge IS NULL").select("range", "run", "best", F.col("n").alias("group_size"))
    at_edges = runs.filter("edge IS NOT NULL").select("range", "run", "edge").join(joined, "edge").select("range", "run", "best", "group_size")
    kept = (F.col("best.range") == F.col("range")) & (F.col("best.place") == F.col("place"))
    return slim.join(whole.unionByName(at_edges), ["range", "run"]).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text) that stay, with its columns; of rows that repeat an id and a text, one. The
    first row of each run is the best of its range; only those of the two runs at a range's edges are compared with other
    ranges'. Texts are shuffled once."""
    # Whole rows are shuffled in place of the normalised text, which is made again from them.
    norm = without_spaces(text_of())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.length(text_of()).alias("n_chars"), norm.substr(1, HEAD).alias("head"), F.sha2(norm, 256).alias("sha"))
    keyed = _with_tie(rows.withColumn("sort_key", F.concat("head", F.lit("\x00"), "sha")).drop("head"))
    ahead = _sorted_runs(keyed, docs, "row").filter("first_of_run OR edge IS NOT NULL")
    ahead = stash(ahead.withColumn("at_edge", F.col("edge").isNotNull()).drop("edge"))
    heads, edges = ahead.filter("first_of_run"), ahead.filter("at_edge").select("range", "run").distinct()
    inner = heads.join(F.broadcast(edges), ["range", "run"], "left_anti")  # two runs a range at most
    outer = heads.join(F.broadcast(edges), ["range", "run"], "left_semi")
    best = outer.groupBy(without_spaces(text_of("row.text")).alias("norm")).agg(F.min(_best()).alias("best"))
    stay = best.select(F.col("best.range").alias("range"), F.col("best.place").alias("place"))
    return inner.select("row.*").unionByName(outer.join(stay, ["range", "place"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
