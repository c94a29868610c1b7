"""Documents to overlapping chunks (K1 to K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.text import strip
from kelpline.operators import merging

#: Lengths in characters, and the quality of a chunk whose pages aren't scored.
MIN_CHARS, MAX_CHARS, OVERLAP = 300, 800, 100
CHUNK_QUALITY = 0.8


def split_paragraphs(pages: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """doc_id, page_number, segment_no, text: the stripped parts of each page that aren't empty."""
    parts = F.posexplode(F.split(F.coalesce("text", F.lit("")), delimiter)).alias("segment_no", "_part")
    return pages.select("doc_id", "page_number", parts).select("doc_id", "page_number", "segment_no", strip(F.col("_part")).alias("text")).filter("text <> ''")


def _starts(lengths: Column, min_chars: int) -> Column:
    """Where (from 1) a document's groups start, by the lengths of its segments."""
    none = F.struct(F.lit(-1).alias("held"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        joined, at = acc["held"].between(0, min_chars - 1), acc["seen"] + 1
        starts = F.when(joined, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(at)))
        return F.struct(F.when(joined, acc["held"] + 1 + n).otherwise(n).alias("held"), at.alias("seen"), starts.alias("starts"))

    return F.aggregate(lengths, none, step, lambda acc: acc["starts"])


def merge_short(segments: DataFrame, min_chars: int = MIN_CHARS, long: int = merging.LONG) -> DataFrame:
    """doc_id, group_no, page_start, page_end, text: while a segment has fewer than ``min_chars``, the next one of the
    document is joined to it, across pages; a null text counts as empty. The segments of a document with up to ``long``
    of them are one row for a while; those of longer ones stay rows of their own (see ``merging``)."""
    segments = segments.select("doc_id", "page_number", "segment_no", F.coalesce("text", F.lit("")).alias("text"))
    outsized = merging.long_documents(segments, long)
    is_long = F.col("doc_id").eqNullSafe(F.col("_long"))
    gathered = segments.join(outsized, is_long, "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "segment_no", "text"))).alias("s"))
    cut = gathered.withColumn("starts", _starts(F.transform("s", lambda x: F.length(x["text"])), min_chars))
    own = F.transform("starts", lambda at, i: F.slice("s", at, F.coalesce(F.get("starts", i + 1), F.size("s") + 1) - at))
    merged = cut.select("doc_id", F.posexplode(own).alias("group_no", "s"))
    if not outsized.isEmpty():
        rows = merging.group_long(segments.join(outsized, is_long, "left_semi"), min_chars)
        whole = rows.groupBy("doc_id", "group_no").agg(F.sort_array(F.collect_list(F.struct("page_number", "segment_no", "text"))).alias("s"))
        merged = merged.unionByName(whole)
    return merged.select("doc_id", "group_no", F.array_min("s.page_number").alias("page_start"), F.array_max("s.page_number").alias("page_end"), F.array_join(F.col("s.text"), "\n").alias("text"))


def split_long(segments: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows with piece_no: a text above ``max_chars`` is cut after the first sentence end at or beyond ``min_chars``,
    again and again; a last piece under ``min_chars`` is glued to the one before it."""
    cut = F.regexp_extract_all("text", F.lit(rf"((?s).{{{min_chars - 1},}}?[。！？\n]|(?s).+)"))
    raw = F.when(F.length("text") > max_chars, cut).otherwise(F.array("text"))
    rows = segments.withColumn("_raw", raw).withColumn("_n", F.size("_raw"))
    short = (F.col("_n") > 1) & (F.length(strip(F.element_at("_raw", -1))) < min_chars)
    stripped = F.transform(F.slice("_raw", 1, F.col("_n") - F.when(short, 2).otherwise(0)), strip)
    glued = F.concat(strip(F.get("_raw", F.col("_n") - 2)), F.get("_raw", F.col("_n") - 1))
    pieces = F.when(short, F.concat(stripped, F.array(glued))).otherwise(stripped)
    kept = F.filter(pieces, lambda p: strip(p) != "")
    return rows.withColumn("_pieces", kept).drop("text", "_raw", "_n").select("*", F.posexplode("_pieces").alias("piece_no", "text")).drop("_pieces")


def number_chunks(pieces: DataFrame) -> DataFrame:
    order = W.partitionBy("doc_id").orderBy("group_no", "piece_no")
    return pieces.withColumn("chunk_no", F.row_number().over(order) - 1)


def add_overlap(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``text`` begins with the last ``overlap`` characters of the previous chunk of the document and a line break."""
    previous = F.lag("text").over(W.partitionBy("doc_id").orderBy("chunk_no"))
    tail = F.substring(previous, F.greatest(F.length(previous) - overlap + 1, F.lit(1)), F.lit(overlap))
    return chunks.withColumn("_tail", tail).withColumn("text", F.when(F.col("_tail").isNull(), F.col("text")).otherwise(F.concat("_tail", F.lit("\n"), "text"))).drop("_tail")


def chunk_title(chunks: DataFrame) -> DataFrame:
    first = strip(F.substring_index(strip(F.col("text")), "\n", 1))
    return chunks.withColumn("title", F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).otherwise(first))


def chunk_id(chunks: DataFrame, source_type: str = "pdf_book") -> DataFrame:
    """Ids that a rerun gives again: 16 digits of a digest of document and chunk number."""
    kind = source_type.replace("_", "")[:12]
    digest = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")), 256), 1, 16)
    return chunks.withColumn("id", F.concat(F.lit(f"ku_{kind}_"), digest))


def chunk_documents(
    pages: DataFrame, delimiter: str = "\n\n", source_type: str = "pdf_book", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, quality: str = "constant",
) -> DataFrame:
    """Units (id, unit_type, source_type, doc_id, chunk_no, title, text, page_start, page_end, quality_score) of pages
    (doc_id, page_number, text). With ``quality`` "page" a unit's score is the least of its pages' quality_score, else 0.8."""
    pieces = number_chunks(split_long(merge_short(split_paragraphs(pages, delimiter), min_chars), max_chars, min_chars))
    units = chunk_id(chunk_title(add_overlap(pieces, overlap)), source_type)
    score = F.lit(CHUNK_QUALITY)
    if quality == "page":
        scores = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_number", "quality_score"))).alias("_scores"))
        own = F.transform(F.sequence("page_start", "page_end"), lambda p: F.try_element_at("_scores", p))
        units, score = units.join(scores, "doc_id"), F.array_min(own)
    return units.select(
        "id", F.lit("semantic_chunk").alias("unit_type"), F.lit(source_type).alias("source_type"),
        "doc_id", "chunk_no", "title", "text", "page_start", "page_end", score.alias("quality_score"),
    )
