"""The driver tables read as units, requests and replies, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is one page."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).alias("page_number"), "text", F.when(F.col("lang") == "es", "ocr").otherwise("text_layer").alias("parse_method"))


_LABELLED = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
"""

#: Both engines read this: units of the documents, with status and risks by label and tags by language and source.
UNITS = f"""
SELECT cast(doc_id AS {{string}}) AS id, 'semantic_chunk' AS unit_type,
  CASE lang WHEN 'en' THEN 'pdf_book' WHEN 'de' THEN 'guideline' WHEN 'fr' THEN 'paper' WHEN 'es' THEN 'markdown' ELSE 'case' END AS source_type,
  CASE WHEN quality = 0 THEN 'quarantined' WHEN quality = 1 THEN 'main' ELSE 'candidate' END AS source_status,
  substring(text, 1, 40) AS title, text, '' AS summary, source AS source_title, doc_id AS page_start, doc_id AS page_end,
  array(concat('topic_', source)) AS semantic_tags, array(lang, source) AS scenario_tags,
  array(CASE WHEN n_chars < 1000 THEN 'patient' WHEN n_chars < 5000 THEN 'family' ELSE 'nurse' END) AS role_tags,
  CASE WHEN toxic = 1 THEN array('Toxic words', 'risk of harm') ELSE {{empty}} END AS contraindications,
  CASE WHEN toxic = 1 THEN array('high') ELSE array('low') END AS risk_levels,
  CASE lang WHEN 'en' THEN array('mindfulness', 'healing') WHEN 'de' THEN array('communication') WHEN 'fr' THEN array('personalized') ELSE {{empty}} END AS card_targets,
  CASE WHEN quality = 0 THEN 0.3D0 WHEN quality = 1 THEN 0.9D0 ELSE 0.6D0 END AS quality_score
FROM ({_LABELLED}) labelled
"""

#: Requests of the benchmark passages, with what is expected of their answers.
REQUESTS = """
SELECT item_id AS query_id, 0 AS rewrite_no, text,
  array(CASE item_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'src1' END) AS scenario_tags,
  array(CASE item_id % 3 WHEN 0 THEN 'patient' WHEN 1 THEN 'family' ELSE 'nurse' END) AS role_focus,
  CASE WHEN item_id % 2 = 0 THEN array('toxic') ELSE {empty} END AS risk_signals,
  CASE WHEN item_id % 5 = 0 THEN array('harm') ELSE {empty} END AS contraindication_signals,
  CASE item_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level,
  concat('scenario_', cast(item_id % 5 AS {string})) AS scenario,
  array(concat('topic_src', cast(item_id % 20 AS {string})), 'en') AS expected_tags,
  array('pdf_book', 'paper') AS must_include_source_types, array('healing', 'communication') AS must_include_card_targets,
  array('quarantined') AS must_not_include_flags
FROM benchmark
"""

_SPARK = {"string": "string", "empty": "cast(array() AS array<string>)"}
_DUCK = {"string": "varchar", "empty": "cast([] AS varchar[])"}


def _duck(sql: str) -> str:
    return sql.format(**_DUCK).replace("array(", "list_value(").replace("D0", "::DOUBLE")


UNITS_SQL, REQUESTS_SQL = _duck(UNITS), _duck(REQUESTS)


def _read(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    filled = _named(sql.format(**_SPARK).replace("D0", "D"), names)
    return spark.sql(filled, **{n: table(spark, sf_dir, n) for n in names})


def _named(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, UNITS, "documents", "labels")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, REQUESTS, "benchmark")
