"""Language identification by compression with a zstandard dictionary of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table

#: Bytes of a language's raw-content dictionary, and of the passage that a training document gives to it. A language
#: takes DICTIONARY / PASSAGE passages: a bounded sample of the labelled rows. Very many languages share MODEL bytes.
DICTIONARY, PASSAGE, MODEL = 98_304, 1_024, 50_000_000
#: Bytes compressed at a time; a whole text is compressed block by block, so that a long text can't become its own
#: dictionary.
BLOCK = 512
LEVEL = 6
#: A narrower margin between the two smallest sizes, as a share of the smallest, rejects the prediction.
NARROW = 0.01
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out() -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 by 4."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def train(docs: DataFrame, model_bytes: int = MODEL) -> dict[str, bytes]:
    """A dictionary for each lang of ``docs`` (doc_id, text, lang), the one with the most rows first: letters of passages of
    the rows with the least digests. Rows without lang or text teach nothing. The driver gets DICTIONARY bytes a language,
    or less where there are so many that ``model_bytes`` don't hold that (each has a passage at least)."""
    passage = F.substring("text", 1, PASSAGE)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    rank = F.struct(F.md5(F.col("doc_id").cast("string")).alias("digest"), "doc_id")
    first = rows.select("lang", rank.alias("rank"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"), passage.alias("passage"))
    salted = W.partitionBy("lang", "salt").orderBy("rank", "passage")
    whole = W.partitionBy("lang").orderBy("rank", "passage")
    common = stash(rows.groupBy("lang").count())
    each = max(1, min(DICTIONARY, model_bytes // max(1, common.count())) // PASSAGE)
    kept = (
        first.withColumn("at", F.row_number().over(salted))
        .filter(F.col("at") <= each)
        .withColumn("at", F.row_number().over(whole))
        .filter(F.col("at") <= each)
    )
    passages = kept.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "passage")), asc=False).alias("p"))
    ordered = passages.join(common, "lang").orderBy(F.desc("count"), "lang").collect()
    return {r["lang"]: "\n".join(letters_of(x["passage"]) for x in r["p"]).encode("utf-8", "surrogatepass")[-DICTIONARY:] for r in ordered}


def letters_of(text: str) -> str:
    """Runs of letters in lower case, one space between: case, digits and symbols say nothing of a language."""
    return " ".join(_LETTERS.findall(text.lower()))


def _compressors(dictionaries: dict[str, bytes]) -> list:
    import zstandard

    made = []
    for content in dictionaries.values():
        of_lang = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        of_lang.precompute_compress(level=LEVEL)
        made.append(
            zstandard.ZstdCompressor(dict_data=of_lang, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        )
    return made


def _sizes(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    compressors = [c.compress for c in _compressors(dictionaries)]
    for batch in batches:
        found = np.zeros((batch.num_rows, len(compressors)), np.int64)
        for at, text in enumerate(batch.column("text")):
            content = text.as_py()
            if content:
                data = letters_of(content).encode("utf-8", "surrogatepass")
                blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
                for k, compress in enumerate(compressors):
                    found[at, k] = sum(len(compress(b)) for b in blocks)
        flat = pa.array(found.ravel())
        ends = pa.array(np.arange(0, found.size + 1, len(compressors), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, flat)], ["doc_id", "has_letter", "sizes"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row of ``docs`` (doc_id, text).

    A text's letters are compressed with every language's dictionary; the smallest total names the language (of equal
    ones, the one with the most training rows).
    margin is what the second smallest has more, as a share of the smallest, and a margin under ``narrow`` rejects the
    prediction. score is the share of the smallest's weight when a size s weighs exp(-(s - smallest) / 8). A null text
    or one without a letter is UNKNOWN with score 0, and so is every text when there is no dictionary.
    """
    names = list(dictionaries)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", has_letter.alias("has_letter"), F.when(has_letter, F.col("text")).alias("text"))
    if not names:
        return rows.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected")
        )
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most MODEL bytes, or a passage a language
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sized = rows.mapInArrow(lambda b: _sizes(b, shared.value), f"doc_id {id_type}, has_letter boolean, sizes array<bigint>")
    ranked = sized.withColumn("ranked", F.array_sort(F.transform("sizes", lambda size, at: F.struct(size.alias("size"), at.alias("at")))))
    ranked = ranked.select("doc_id", "has_letter", "sizes", F.get(F.lit(names), F.col("ranked")[0]["at"]).alias("best"), F.array_min("sizes").alias("least"), F.get(F.sort_array("sizes"), F.lit(1)).alias("second"))
    weights = F.aggregate("sizes", F.lit(0.0), lambda total, s: total + F.exp(-(s - F.col("least")) / 8.0))
    margin = F.coalesce(F.try_divide(F.col("second") - F.col("least"), F.col("least")), F.lit(1.0))
    return ranked.select(
        "doc_id",
        F.when(F.col("has_letter"), F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letter"), 1 / weights).otherwise(0.0).alias("score"),
        F.when(F.col("has_letter"), margin).otherwise(0.0).alias("margin"),
        (~F.col("has_letter") | (margin < narrow)).alias("rejected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
