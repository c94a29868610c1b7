"""Sets of units: registry, upserts, counts, look-ups, annotation sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import PRIORITY_STATUS, SOURCE_KINDS
from kelpline.functions.text import preview, strip
from kelpline.operators.matching import contained
from kelpline.operators.storage import stash


def detect_source_type(files: DataFrame, path: str) -> DataFrame:
    end = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return files.withColumn("source_type", F.when(end.isin(".md", ".docx", ".txt"), "markdown").when(end == ".jsonl", "case").otherwise("pdf_book"))


def pick_page_text(pages: DataFrame, layer: str = "layer_text", ocr: str = "ocr_text", least: int = 50) -> DataFrame:
    """text, parse_method and confidence: the text layer if it has enough text, else the OCR text, else the layer."""
    enough = F.length(strip(F.coalesce(layer, F.lit("")))) >= least
    has_ocr = strip(F.coalesce(ocr, F.lit(""))) != ""
    return pages.withColumns(
        {
            "text": F.when(enough, F.col(layer)).when(has_ocr, F.col(ocr)).otherwise(F.coalesce(layer, F.lit(""))),
            "parse_method": F.when(~enough & has_ocr, "ocr").otherwise("text_layer"),
            "confidence": F.when(enough, 1.0).when(has_ocr, 0.7).otherwise(0.3),
        }
    )


def _mapped(column: Column, values: dict[str, str | None]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair if pair[1] is not None])[column]


def plan_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each manifest row with source_type, path, source_status and reason (null: import it). A file is found by its name,
    or else by the first 60 characters of one name within the other (of several files the first name), which meet by a gram."""
    name = F.substring_index(F.substring_index(F.regexp_replace(F.trim("local_path"), r"\\", "/"), "/", -1), " | ", 1)
    rows = manifest.withColumns(
        {
            "_name": name,
            "source_type": _mapped(F.trim("source_type_for_RAG"), SOURCE_KINDS),
            "source_status": F.coalesce(_mapped(F.trim("priority"), PRIORITY_STATUS), F.lit("candidate")),
            "title": F.coalesce("normalized_title", "title"),
        }
    )
    usable = F.col("source_type").isNotNull() & (F.coalesce(F.trim("local_path"), F.lit("")) != "")
    listed = files.groupBy("file_name").agg(F.max("full_path").alias("full_path"))
    exact = rows.join(listed, rows["_name"] == listed["file_name"], "left").drop("file_name")
    rest = exact.filter(usable & F.col("full_path").isNull()).select("item_id", "_name")
    begin = lambda column: F.substring(column, 1, 60)
    in_file = contained(rest.select(begin("_name").alias("needle")), listed.select(F.col("file_name").alias("hay")))
    of_file = contained(listed.select(begin("file_name").alias("needle")), rest.select(F.col("_name").alias("hay")))
    by_begin = rest.withColumn("needle", begin("_name")).join(in_file, "needle").select("item_id", F.col("hay").alias("file_name"))
    by_file = rest.join(of_file, rest["_name"] == of_file["hay"]).select("item_id", "needle")
    by_file = by_file.join(listed.select("file_name", begin("file_name").alias("needle")), "needle").select("item_id", "file_name")
    near = by_begin.unionByName(by_file).join(listed, "file_name").groupBy("item_id").agg(F.min_by("full_path", "file_name").alias("_near"))
    found = exact.join(near, "item_id", "left").withColumn("path", F.when(usable, F.coalesce("full_path", "_near")))
    reason = F.when(F.col("source_type").isNull(), "kind").when(~usable, "no path").when(F.col("path").isNull(), "no file")
    return found.withColumn("reason", reason).select("item_id", "title", "path", "source_type", "source_status", "reason")


def filter_new_documents(docs: DataFrame, registry: DataFrame, key: str = "file_path") -> DataFrame:
    """Documents that aren't registered, whatever the status of those that are."""
    return docs.join(registry.select(key).distinct(), key, "left_anti")


def skipped_documents(docs: DataFrame, registry: DataFrame, key: str = "file_path") -> DataFrame:
    return docs.join(registry.select(key).distinct(), key, "left_semi").withColumn("parse_status", F.lit("skipped"))


def content_hash(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.coalesce(column, F.lit("")), 256))


def duplicate_content(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content_hash, first: documents that share their content with one of a smaller key. Digests are shuffled."""
    hashed = content_hash(docs).select(key, "content_hash")
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("first"))
    return hashed.join(first, "content_hash").filter(F.col(key) > F.col("first")).select(key, "content_hash", "first")


#: Tasks that write a status; a status may hold nearly all units.
WRITERS = 64


def upsert_units(existing: DataFrame, incoming: DataFrame, version: str = "updated_at") -> DataFrame:
    """Insert or replace by id: the incoming row wins, and of several the one with the latest version."""
    both = existing.withColumn("_turn", F.lit(0)).unionByName(incoming.withColumn("_turn", F.lit(1)))
    last = W.partitionBy("id").orderBy(F.desc("_turn"), F.desc(version))
    return both.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", "_turn")


#: Folders of a table of units by id.
ID_BUCKETS = 64


def id_bucket(buckets: int = ID_BUCKETS) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def create_units_table(units: DataFrame, path: str, buckets: int = ID_BUCKETS) -> None:
    """Write ``units`` below ``path`` in folders by a hash of the id."""
    units.withColumn("bucket", id_bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert_units_table(incoming: DataFrame, path: str, buckets: int = ID_BUCKETS, version: str = "updated_at") -> list[int]:
    """``upsert_units`` of ``incoming`` into the table at ``path``; the folders that were written again. Only folders with an
    incoming id are read and replaced; files of the others stay as they are. Their new rows are written elsewhere first,
    so that nothing is read from a folder while it is replaced."""
    spark = incoming.sparkSession
    new = stash(incoming.withColumn("bucket", id_bucket(buckets)))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    merged = stash(upsert_units(old.select(*new.columns), new, version))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def ingest_results(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, total_segments, chunk_count (not quarantined), quarantined_count, parse_status."""
    bad = F.col("source_status") == "quarantined"
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("total_segments"), F.count_if(bad).alias("quarantined_count"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("total_segments", "quarantined_count")}
    rows = docs.select("doc_id").join(counts, "doc_id", "left").withColumns(filled)
    return rows.withColumn("chunk_count", F.col("total_segments") - F.col("quarantined_count")).withColumn(
        "parse_status", F.when(F.col("total_segments") > 0, "completed").otherwise("empty")
    )


def export_annotation_sheet(units: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows to annotate with rank_group 0 for units of high risk or with a keyword, 1 for all others."""
    hit = F.greatest(*[F.coalesce("text", F.lit("")).contains(k).cast("int") for k in keywords], F.array_contains("risk_levels", "high").cast("int"), F.lit(0)) == 1
    return units.select(
        F.col("id").alias("chunk_id"), "source_title", "page_start", preview(F.col("text"), 300).alias("text_preview"),
        F.array_join("semantic_tags", ",").alias("current_semantic_tags"), F.array_join("risk_levels", ",").alias("current_risk_levels"),
        F.when(hit, 0).otherwise(1).alias("rank_group"),
    )


def merge_annotations(units: DataFrame, sheet: DataFrame) -> DataFrame:
    """Units with contraindications and risk levels of the filled sheet; blank cells leave none, and the old risk."""
    listed = F.filter(F.transform(F.split(F.coalesce("annotated_contraindications", F.lit("")), "[,，]"), lambda c: F.trim(c)), lambda c: c != "")
    risk = F.trim("annotated_risk_level")
    filled = sheet.select(F.col("chunk_id").alias("id"), listed.alias("_contra"), F.when(risk != "", F.array(risk)).alias("_risk"))
    joined = units.join(filled, "id", "left")
    return joined.withColumn("contraindications", F.coalesce("_contra", "contraindications")).withColumn("risk_levels", F.coalesce("_risk", "risk_levels")).drop("_contra", "_risk")


def write_units(units: DataFrame, path: str) -> None:
    """Write units as one folder for each source status, so that readers of a status skip the others."""
    units.repartition("source_status", F.pmod(F.xxhash64("id"), F.lit(WRITERS))).write.mode("overwrite").partitionBy("source_status").parquet(path)


def kb_overview(units: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """dimension, value, n: units by status, type and source type in one pass, and the number of ``documents``."""
    if documents is not None:
        total = documents.agg(F.count("*").alias("n")).select(F.lit("documents").alias("dimension"), F.lit("all").alias("value"), "n")
        return kb_overview(units).unionByName(total)
    counted = units.groupingSets([["source_status"], ["unit_type"], ["source_type"]], "source_status", "unit_type", "source_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    names = F.when(F.col("g") == 3, "source_status").when(F.col("g") == 5, "unit_type").otherwise("source_type")
    value = F.when(F.col("g") == 3, F.col("source_status")).when(F.col("g") == 5, F.col("unit_type")).otherwise(F.col("source_type"))
    return counted.select(names.alias("dimension"), value.alias("value"), "n")


def get_by_ids(units: DataFrame, ids: DataFrame) -> DataFrame:
    """All look-ups as one join."""
    return units.join(ids.select("id").distinct(), "id", "left_semi")
