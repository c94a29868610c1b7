"""Incremental ingest: only files that aren't registered are chunked and appended, to the units and to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpline.operators.chunking import chunk_documents
from kelpline.operators.index_store import add_to_index
from kelpline.operators.repository import filter_new_documents
from kelpline.operators.storage import read_if_there

REGISTRY = "file_path string, total_pages long, parse_status string, batch_id string"


def ingest_incremental(pages: DataFrame, registry: DataFrame | None, delimiter: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """Chunks and registry rows of the documents of ``pages`` (file_path, page_number, text) that aren't registered."""
    new = pages if registry is None else filter_new_documents(pages, registry)
    chunks = chunk_documents(new.select(F.col("file_path").alias("doc_id"), "page_number", "text"), delimiter)
    return chunks, new.groupBy("file_path").agg(F.count("*").alias("total_pages")).withColumn("parse_status", F.lit("completed"))


def ingest_batch(pages: DataFrame, batch: str, units: str, registry: str, index: str | None = None, delimiter: str = "\n\n", status: str = "candidate") -> None:
    """Write the chunks of a batch's new documents below ``units``, add them to the ``index``, then register the documents. A
    batch that is run again finds only other batches' documents registered, writes over its own chunks and rows, and its
    generation is in the index at most once; one that broke off anywhere is made whole by its next run."""
    spark = pages.sparkSession
    known = read_if_there(spark, registry, REGISTRY)
    known = None if known is None else known.filter(F.col("batch_id") != batch)
    chunks, rows = ingest_incremental(pages, known, delimiter)
    folder = _folder_of(batch)
    chunks.withColumn("source_status", F.lit(status)).write.mode("overwrite").parquet(f"{units}/{folder}")
    if index is not None:
        add_to_index(spark.read.parquet(f"{units}/{folder}"), index, batch)
    rows.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").parquet(f"{registry}/{folder}")


def _folder_of(batch: str) -> str:
    return "batch-" + "".join(c if c.isalnum() else "-" for c in batch)


def stream_documents(
    spark: SparkSession, source: str, schema: str, units: str, registry: str, checkpoint: str, delimiter: str = "\n\n", index: str | None = None
) -> StreamingQuery:
    """Watch a folder of page files (Parquet); each batch of new files goes through ``ingest_batch``. Batches are named by
    checkpoint and number, as another checkpoint counts anew."""

    def batch(pages: DataFrame, number: int) -> None:
        ingest_batch(pages, f"{checkpoint}#{number}", units, registry, index, delimiter)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
