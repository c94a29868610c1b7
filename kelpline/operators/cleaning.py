"""Page cleaning, quality scores, status and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import CARD_TARGETS, CONTENTS_MARKS, COPYRIGHT_MARKS, REVIEW_STATUSES, SOURCE_TYPES, STATUSES, UNIT_TYPES
from kelpline.functions.text import CJK, GARBLE, SPARSE, strip
from kelpline.operators.storage import stash

#: What each flag takes off the score, and the score from which a page passes.
PENALTIES = {
    "too_short": 0.3,
    "table_of_contents": 0.9,
    "copyright_page": 0.9,
    "possible_ocr_garble": 0.3,
    "isolated_characters": 0.4,
    "low_information_density": 0.3,
}
PASSING = 0.5


def clean_pages(pages: DataFrame, column: str = "text") -> DataFrame:
    """Without lines that are a page number, "第 N 页", and more than one blank line in a row."""
    text = F.regexp_replace(column, r"(?mU)^\s*\d{1,4}\s*$", "")
    text = F.regexp_replace(text, r"(?U)第\s*\d+\s*页", "")
    return pages.withColumn(column, strip(F.regexp_replace(text, r"\n{3,}", "\n\n")))


def _contains_any(text: Column, marks: list[str]) -> Column:
    return F.greatest(*[text.contains(m).cast("int") for m in marks], F.lit(0)) == 1


def quality_flags(pages: DataFrame, column: str = "text", cjk: bool = True) -> DataFrame:
    """``quality_flags``, in the order of PENALTIES. With ``cjk`` false, texts aren't asked for CJK characters."""
    text = F.coalesce(F.col(column), F.lit(""))
    n = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    conditions = {
        "too_short": n < 20,
        "table_of_contents": _contains_any(text, CONTENTS_MARKS) & text.contains("...."),
        "copyright_page": sum((text.contains(m).cast("int") for m in COPYRIGHT_MARKS), F.lit(0)) >= 2,
        "possible_ocr_garble": F.when(n >= 10, share(GARBLE) > 0.3),
        "isolated_characters": F.lit(cjk) & (F.regexp_count(text, F.lit(CJK)) < 5) & (strip(text) != ""),
        "low_information_density": F.when(n >= 30, share(SPARSE) > 0.7),
    }
    raised = F.array(*[F.when(conditions[name], F.lit(name)) for name in PENALTIES])
    return pages.withColumn("quality_flags", F.filter(raised, lambda f: f.isNotNull()))


def quality_score(pages: DataFrame) -> DataFrame:
    """``quality_score`` from parse_method and quality_flags."""
    base = F.when(F.col("parse_method") == "text_layer", 1.0).otherwise(0.7)
    score = base
    for name, penalty in PENALTIES.items():
        score = score - F.when(F.array_contains("quality_flags", name), penalty).otherwise(0.0)
    return pages.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), score), 6))


def route_status(pages: DataFrame, desired: str = "main") -> DataFrame:
    return pages.withColumn("source_status", F.when(F.col("quality_score") >= PASSING, F.lit(desired)).otherwise("quarantined"))


#: Page numbers of a range of a document, and flagged pages that are sent to where the pages are.
PAGE_RANGE, MOST_FLAGGED = 1_024, 500_000


def pages_before(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, before: the number of the page before in the document; of pages that have one. A window sees a
    range of page numbers, so a book of any length is many tasks'; the last page of the ranges before is joined, of which
    a document has a row for each range."""
    own = pages.select("doc_id", "page_number").distinct().withColumn("_range", F.floor(F.col("page_number") / PAGE_RANGE))
    inside = own.withColumn("before", F.lag("page_number").over(W.partitionBy("doc_id", "_range").orderBy("page_number")))
    ends = own.groupBy("doc_id", "_range").agg(F.max("page_number").alias("_end"))
    edges = ends.select("doc_id", "_range", F.lag("_end").over(W.partitionBy("doc_id").orderBy("_range")).alias("_edge")).filter("_edge IS NOT NULL")
    first = inside.filter("before IS NULL").drop("before").join(edges, ["doc_id", "_range"]).select("doc_id", "page_number", F.col("_edge").alias("before"))
    return inside.filter("before IS NOT NULL").select("doc_id", "page_number", "before").unionByName(first)


def flag_duplicates(pages: DataFrame, similarity: float = 0.9) -> DataFrame:
    """``duplicate_of``: the first row (doc_id, page_number) with the same words in lower case, or the page before if the
    two share more than ``similarity`` of their distinct words; null otherwise. Digests and sets of 64-bit hashes of words
    are shuffled, by page; what comes back to the pages is the flagged ones, and texts stay where they are while these
    are MOST_FLAGGED at most. Rows of one page of a document are told apart by nothing: they share what is flagged."""
    place = F.struct("doc_id", "page_number")
    lower = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_distinct(F.transform(F.split(strip(lower), r"\s+"), lambda w: F.xxhash64(w)))
    slim = stash(pages.select("doc_id", "page_number", words.alias("_words"), F.md5(F.regexp_replace(lower, r"\s+", " ")).alias("_digest")))
    first = slim.groupBy("_digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    copies = slim.select("doc_id", "page_number", "_digest").join(first, "_digest").filter(F.col("_first") < place).select("doc_id", "page_number", "_first")
    sets = slim.groupBy("doc_id", "page_number").agg(F.max("_words").alias("_words"))
    theirs = sets.select("doc_id", F.col("page_number").alias("before"), F.col("_words").alias("_other"))
    both = pages_before(slim).join(sets, ["doc_id", "page_number"]).join(theirs, ["doc_id", "before"])
    shared = F.size(F.array_intersect("_words", "_other")) / F.size(F.array_union("_words", "_other"))
    near = both.filter(shared > similarity).select("doc_id", "page_number", F.struct("doc_id", F.col("before").alias("page_number")).alias("_first"))
    # A copy of an earlier row counts before a likeness to the page before.
    ranked = copies.withColumn("_rank", F.lit(0)).unionByName(near.withColumn("_rank", F.lit(1)))
    found = stash(ranked.groupBy("doc_id", "page_number").agg(F.min_by("_first", F.struct("_rank", "_first")).alias("duplicate_of")))
    return pages.join(F.broadcast(found) if found.count() <= MOST_FLAGGED else found, ["doc_id", "page_number"], "left").select(*pages.columns, "duplicate_of")


def active_units(units: DataFrame) -> DataFrame:
    return units.filter(F.col("source_status").isin("main", "candidate"))


def units_by_status(units: DataFrame, status: str) -> DataFrame:
    return units.filter(F.col("source_status") == status)


def validate_units(units: DataFrame) -> DataFrame:
    """id and violated rule, a row for each violation. Columns that ``units`` hasn't got aren't judged; review status and
    card targets may be missing from a row, as they have defaults."""
    known = lambda c, values: ~F.coalesce(F.col(c).isin(values), F.lit(False))
    rules = {
        "id_missing": ("id", lambda: F.col("id").isNull()),
        "text_missing": ("text", lambda: F.col("text").isNull()),
        "unit_type_unknown": ("unit_type", lambda: known("unit_type", UNIT_TYPES)),
        "source_type_unknown": ("source_type", lambda: known("source_type", SOURCE_TYPES)),
        "source_status_unknown": ("source_status", lambda: known("source_status", STATUSES)),
        "review_status_unknown": ("review_status", lambda: F.col("review_status").isNotNull() & known("review_status", REVIEW_STATUSES)),
        "card_target_unknown": ("card_targets", lambda: F.coalesce(F.exists("card_targets", lambda t: ~t.isin(CARD_TARGETS)), F.lit(False))),
        "quality_score_out_of_range": ("quality_score", lambda: ~F.coalesce(F.col("quality_score").between(0.0, 1.0), F.lit(False))),
        "created_at_missing": ("created_at", lambda: F.col("created_at").isNull()),
        "updated_at_missing": ("updated_at", lambda: F.col("updated_at").isNull()),
    }
    found = [F.when(broken(), F.lit(name)) for name, (column, broken) in rules.items() if column in units.columns]
    return units.select("id", F.explode(F.array_compact(F.array(*found))).alias("rule"))
