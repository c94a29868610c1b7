"""Readers of pages and evaluation sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVAL_SCHEMA = (
    "query string, patient_context string, family_context string, expected_tags array<string>, must_include_source_types array<string>, "
    "must_include_card_targets array<string>, must_include_ids array<string>, must_not_include_flags array<string>, risk_level string, human_notes string, scenario string"
)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """A file is one page of its text layer."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.lit(1).alias("page_number"), F.col("value").alias("text"), F.lit("text_layer").alias("parse_method"), F.lit(1.0).alias("confidence"))


def _numbered_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with their number in their part of a file; a task reads its parts one after another."""
    last, seen = None, 0
    for batch in batches:
        numbers = []
        for part in zip(batch.column("file_path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            last, seen = part, seen + 1 if part == last else 1
            numbers.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "at"])


def numbered_lines(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """file_path, line_number (from 1), line of text files that may be of any size: lines are numbered in each part of a file
    that a task reads, and the parts before have so many. With ``through``, numbers go on through the files of a folder, in
    order of their names. The second reading counts lines only; of a file there is a row for each part to sum up, which the
    lines get by broadcast."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"), "value")
    parts = lines.groupBy("file_path", "start").agg(F.count("*").alias("n"))
    run = F.regexp_replace("file_path", "[^/]*$", "") if through else F.col("file_path")
    before = F.sum("n").over(W.partitionBy(run).orderBy("file_path", "start").rowsBetween(W.unboundedPreceding, -1))
    offsets = parts.select("file_path", "start", before.alias("before")).filter("before IS NOT NULL")
    own = lines.mapInArrow(_numbered_lines, "file_path string, start long, value string, at long")
    return own.join(F.broadcast(offsets), ["file_path", "start"], "left").select("file_path", (F.col("at") + F.coalesce("before", F.lit(0))).alias("line_number"), F.col("value").alias("line"))


def read_jsonl_pages(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """A line that isn't blank is a page; its number counts blank lines too, of its file or (``through``) of its folder. The
    text is the field text, else content, else the line itself, as for lines that aren't JSON."""
    line = F.trim(F.regexp_replace("line", "\r$", ""))
    text = F.coalesce(F.get_json_object("line", "$.text"), F.get_json_object("line", "$.content"), line)
    pages = numbered_lines(spark, path, through).filter(line != "")
    return pages.select("file_path", F.col("line_number").cast("int").alias("page_number"), text.alias("text"), F.lit("text_layer").alias("parse_method"), F.lit(1.0).alias("confidence"))


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).json(path).filter("query IS NOT NULL")
