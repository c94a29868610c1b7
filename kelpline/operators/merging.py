"""Groups of short segments in documents of any length: no task, row or window holds the texts of a whole long document.

A segment starts where the lengths before it (with one character between two segments) end; the start of the next group is
the first one that lies more than ``min_chars`` beyond that of a group. So a segment's next start is a range lookup, and the
starts that follow from a document's first one are found by doubling these pointers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.operators.storage import stash

#: A document with more segments is long. Its offsets are dealt in ranges of so many characters.
LONG, RANGE = 2048, 1 << 20


def long_documents(segments: DataFrame, limit: int = LONG) -> DataFrame:
    """doc_id of the documents that have more than ``limit`` segments."""
    return stash(segments.groupBy("doc_id").count().filter(F.col("count") > limit).select(F.col("doc_id").alias("_long")))


def offsets(segments: DataFrame) -> DataFrame:
    """The rows with ``_at``, the characters before a segment: sums by page, then within a page."""
    size = (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")
    pages = segments.groupBy("doc_id", "page_number").agg(F.sum(size).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("doc_id").orderBy("page_number")) - F.col("_n")
    pages = pages.select(F.col("doc_id").alias("_doc"), F.col("page_number").alias("_page"), before.alias("_before"))
    within = F.sum(size).over(W.partitionBy("doc_id", "page_number").orderBy("segment_no", "text").rowsBetween(W.unboundedPreceding, 0)) - size
    met = segments.withColumn("_within", within).join(pages, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page_number").eqNullSafe(F.col("_page")))
    return met.withColumn("_at", F.col("_before") + F.col("_within")).drop("_doc", "_page", "_before", "_within")


def _carried(rows: DataFrame, value: str, out: str, forward: bool) -> DataFrame:
    """``out``: the last value that isn't null in order of ``_at`` (from the end unless ``forward``), this row's included;
    where positions are equal a row with a value comes first. Ranges are looked at apart, and hand their last value on."""
    rows = rows.withColumn("_range", F.floor(F.col("_at") / RANGE))
    turn = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    ends = rows.groupBy("doc_id", "_range").agg((F.max if forward else F.min)(value).alias("_end"))
    earlier = F.last("_end", ignorenulls=True).over(W.partitionBy("doc_id").orderBy(turn("_range")).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(F.col("doc_id").alias("_doc"), F.col("_range").alias("_r"), earlier.alias("_earlier"))
    own = F.last(value, ignorenulls=True).over(W.partitionBy("doc_id", "_range").orderBy(turn("_at"), F.col(value).isNull()).rowsBetween(W.unboundedPreceding, 0))
    met = rows.withColumn("_own", own).join(ends, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_range") == F.col("_r")))
    return met.withColumn(out, F.coalesce("_own", "_earlier")).drop("_doc", "_r", "_range", "_earlier", "_own")


def next_starts(starts: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _at, _next of rows doc_id, _at: the first offset of the document at ``_at + min_chars + 1`` or beyond, never
    one that isn't later; segments after which no group starts are left out."""
    asks = starts.select("doc_id", (F.col("_at") + max(min_chars, 0) + 1).alias("_at"), F.lit(None).cast("long").alias("_start"), F.col("_at").alias("_from"))
    rows = starts.select("doc_id", "_at", F.col("_at").alias("_start"), F.lit(None).cast("long").alias("_from")).unionByName(asks)
    found = _carried(rows, "_start", "_next", forward=False)
    return found.filter("_from IS NOT NULL AND _next IS NOT NULL").select("doc_id", F.col("_from").alias("_at"), "_next")


def reached(hops: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, _at of ``first`` and all that follow from them by ``hops`` (doc_id, _at, _next), each hop to a later offset.
    The rows reached double with each turn, as do the hops; turns end when no hop is left."""
    seen, hops = stash(first), stash(hops)
    while not hops.isEmpty():
        to = hops.select(F.col("doc_id").alias("_doc"), F.col("_at").alias("_via"), F.col("_next").alias("_to"))
        new = seen.join(to, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_via"))).select("doc_id", F.col("_to").alias("_at"))
        seen = stash(seen.unionByName(new))
        twice = hops.join(to, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_next") == F.col("_via")))
        hops = stash(twice.select("doc_id", "_at", F.col("_to").alias("_next")))
    return seen


def group_long(segments: DataFrame, min_chars: int) -> DataFrame:
    """The segments of long documents with group_no."""
    placed = stash(offsets(segments))
    starts = placed.select("doc_id", "_at")
    found = reached(next_starts(starts, min_chars), starts.filter("_at = 0"))
    numbered = found.withColumn("_no", F.row_number().over(W.partitionBy("doc_id").orderBy("_at")) - 1)
    marks = numbered.select(F.col("doc_id").alias("_doc"), F.col("_at").alias("_start"), "_no")
    marked = placed.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_start")), "left").drop("_doc", "_start")
    return _carried(marked, "_no", "group_no", forward=True).drop("_no", "_at")
