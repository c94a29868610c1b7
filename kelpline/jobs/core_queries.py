"""Queries over cleaning, chunking, enrichment, cards and the repository, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.lexicon import CONTENTS_MARKS, COPYRIGHT_MARKS
from kelpline.jobs.tables import UNITS_SQL, pages, table, units
from kelpline.operators import chunking, cleaning, enrichment, repository
from kelpline.operators.storage import new_folder
from kelpline.sources import readers

POOL = {"scenario_tags": ["en", "de", "src0", "src3", "src7"], "role_tags": ["patient", "nurse"]}
W_UNITS = f"WITH units AS ({UNITS_SQL})"

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*\d{1,4}\s*$', '', 'g'), '第\s*\d+\s*页', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


def q_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_pages(pages(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.route_status(cleaning.quality_score(cleaning.quality_flags(pages(spark, d))))


def q_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.array_join("quality_flags", ",").alias("flags"))


def q_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "quality_score", "source_status")


_any = lambda marks: " OR ".join(f"contains(t, '{m}')" for m in marks)
_FLAGS = rf"""
p AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, CASE WHEN lang = 'es' THEN 'ocr' ELSE 'text_layer' END AS m FROM documents),
f AS (SELECT doc_id, m,
  n < 20 AS too_short,
  ({_any(CONTENTS_MARKS)}) AND contains(t, '....') AS table_of_contents,
  ({" + ".join(f"contains(t, '{m}')::INT" for m in COPYRIGHT_MARKS)}) >= 2 AS copyright_page,
  n >= 10 AND len(regexp_extract_all(t, '[\x{{9FFF}}-\x{{FEFF}}\x{{FFEF}}-\x{{10FFFF}}]')) / n > 0.3 AS possible_ocr_garble,
  len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}]')) < 5 AND {_STRIP.format("t")} <> '' AS isolated_characters,
  n >= 30 AND len(regexp_extract_all(t, '[ \t\n\r，。、；："！？…—　]')) / n > 0.7 AS low_information_density
  FROM p)"""
SQL_FLAGS = f"WITH {_FLAGS} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in cleaning.PENALTIES) + ") AS flags FROM f"
_SCORE = "greatest(0.0::DOUBLE, CASE WHEN m = 'text_layer' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END " + " ".join(f"- CASE WHEN {n} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for n, v in cleaning.PENALTIES.items()) + ")"
SQL_SCORE = f"WITH {_FLAGS} SELECT doc_id, round({_SCORE}, 6) AS quality_score, CASE WHEN round({_SCORE}, 6) >= 0.5 THEN 'main' ELSE 'quarantined' END AS source_status FROM f"


def q_flag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    book = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")
    rows = cleaning.flag_duplicates(book).filter("duplicate_of IS NOT NULL")
    return rows.select(F.col("doc_id").alias("book"), F.col("page_number").alias("page"), F.col("duplicate_of.doc_id").alias("of_book"), F.col("duplicate_of.page_number").alias("of_page"))


SQL_DUPLICATES = r"""
WITH p AS (SELECT source AS b, doc_id AS n, regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g') AS t,
    list_distinct(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+')) AS w FROM documents),
k AS (SELECT *, first_value(b) OVER s AS fb, first_value(n) OVER s AS fn, lag(n) OVER o AS pn, lag(w) OVER o AS pw FROM p
  WINDOW s AS (PARTITION BY t ORDER BY b, n), o AS (PARTITION BY b ORDER BY n)),
j AS (SELECT *, (fb, fn) < (b, n) AS copy, pn IS NOT NULL AND len(list_intersect(w, pw)) / len(list_distinct(list_concat(w, pw))) > 0.9 AS near FROM k)
SELECT b AS book, n AS page, CASE WHEN copy THEN fb ELSE b END AS of_book, CASE WHEN copy THEN fn ELSE pn END AS of_page FROM j WHERE copy OR near
"""


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_paragraphs(pages(spark, d), "\n").select("doc_id", "segment_no", F.md5("text").alias("text_md5"))


_SEGMENTS = r"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS segment_no FROM documents),
segments AS (SELECT doc_id, segment_no::INT AS segment_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '')"""
_MERGED = f"""{_SEGMENTS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment_no) AS rn FROM segments),
fold AS (
  SELECT doc_id, rn, length(text) AS n, 0 AS g FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn, CASE WHEN f.n < 300 THEN f.n + 1 + length(o.text) ELSE length(o.text) END, CASE WHEN f.n < 300 THEN f.g ELSE f.g + 1 END
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1
),
merged AS (SELECT doc_id, g AS group_no, string_agg(text, chr(10) ORDER BY rn) AS text FROM fold JOIN ordered USING (doc_id, rn) GROUP BY doc_id, g)"""


def q_merge_short(spark: SparkSession, d: str) -> DataFrame:
    merged = chunking.merge_short(chunking.split_paragraphs(pages(spark, d), "\n"))
    return merged.select("doc_id", "group_no", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


_PIECES = rf"""{_MERGED},
raw AS (SELECT doc_id, group_no, CASE WHEN length(text) > 800 THEN regexp_extract_all(text, '(?s).{{299,}}?[。！？\n]|(?s).+') ELSE [text] END AS r FROM merged),
cut AS (SELECT *, len(r) > 1 AND length({_STRIP.format("r[-1]")}) < 300 AS short FROM raw),
glued AS (SELECT doc_id, group_no, CASE WHEN short THEN list_append(list_transform(r[1:len(r) - 2], lambda x: {_STRIP.format("x")}), {_STRIP.format("r[len(r) - 1]")} || r[-1])
  ELSE list_transform(r, lambda x: {_STRIP.format("x")}) END AS k FROM cut),
kept AS (SELECT doc_id, group_no, list_filter(k, lambda x: {_STRIP.format("x")} <> '') AS k FROM glued),
pieces AS (SELECT doc_id, group_no, unnest(k) AS text, generate_subscripts(k, 1) - 1 AS piece_no FROM kept),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_no, piece_no) - 1 AS chunk_no FROM pieces),
overlapped AS (SELECT doc_id, chunk_no, CASE WHEN lag(text) OVER w IS NULL THEN text ELSE right(lag(text) OVER w, 100) || chr(10) || text END AS text FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)),
titled AS (SELECT *, {_STRIP.format("string_split(" + _STRIP.format("text") + ", chr(10))[1]")} AS t FROM overlapped)"""


def q_split_long(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.split_long(whole).select("doc_id", "piece_no", F.md5("text").alias("text_md5"))


SQL_SPLIT = "WITH " + _PIECES[_PIECES.index("raw AS") : _PIECES.index("numbered AS")].replace("FROM merged", "FROM (SELECT doc_id, 0 AS group_no, coalesce(text, '') AS text FROM documents)").rstrip().rstrip(",") + " SELECT doc_id, piece_no::INT AS piece_no, md5(text) AS text_md5 FROM pieces"


def q_chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(pages(spark, d), "\n").select("id", "doc_id", "chunk_no", "title", F.md5("text").alias("text_md5"))


SQL_CHUNKS = f"""WITH RECURSIVE {_PIECES}
SELECT 'ku_pdfbook_' || substring(sha256(doc_id || '|' || chunk_no), 1, 16) AS id, doc_id, chunk_no::INT AS chunk_no, CASE WHEN length(t) > 50 THEN substring(t, 1, 47) || '...' ELSE t END AS title, md5(text) AS text_md5 FROM titled"""


def q_validate_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = enrichment.validate_tags(units(spark, d).select("id", "scenario_tags", "role_tags"), POOL)
    return rows.select("id", F.array_join("scenario_tags", ",").alias("scenario_tags"), F.array_join("role_tags", ",").alias("role_tags"))


_in = lambda c: f"array_to_string(list_filter({c}, lambda x: x IN ({', '.join(repr(t) for t in POOL[c])})), ',') AS {c}"


def q_tag_distribution(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.tag_distribution(units(spark, d), "scenario_tags")


def q_tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.tag_coverage(units(spark, d), ["contraindications"])


def q_card_groups(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.card_groups(units(spark, d)).select("book", "group_no", "group_id", "first", "second", "third")


_GROUPS = """
g0 AS (SELECT source_title AS book, id, row_number() OVER w AS n, lead(id, 1) OVER w AS second, lead(id, 2) OVER w AS third FROM units WINDOW w AS (PARTITION BY source_title ORDER BY page_start, page_end, id)),
g AS (SELECT book, ((n - 1) // 2)::BIGINT AS group_no, concat_ws('+', right(id, 8), right(second, 8), right(third, 8)) AS group_id, id AS first, second, third FROM g0 WHERE (n - 1) % 2 = 0 AND third IS NOT NULL)"""


def _done(groups: DataFrame) -> DataFrame:
    return groups.filter("group_no % 3 = 0").select("group_id")


def q_card_requests(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    groups = enrichment.card_groups(u)
    return enrichment.card_requests(groups, u, _done(groups)).select("group_id", F.md5("prompt").alias("prompt_md5"))


SQL_CARD_REQUESTS = f"""{W_UNITS}, {_GROUPS}
SELECT group_id, md5('Source chunks:' || chr(10) || concat_ws(chr(10) || chr(10), substring(a.text, 1, 500), substring(b.text, 1, 500), substring(c.text, 1, 500))) AS prompt_md5
FROM g JOIN units a ON a.id = first JOIN units b ON b.id = second JOIN units c ON c.id = third WHERE group_no % 3 <> 0"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    groups = enrichment.card_groups(u)
    reply = F.to_json(F.struct(F.when(F.col("group_no") % 7 != 0, F.concat(F.lit("card "), "group_id")).alias("title"), F.col("first").alias("text"), F.array(F.lit("healing"), F.lit("other")).alias("card_targets")))
    replies = groups.select("group_id", F.when(F.col("group_no") % 11 == 0, "{bad").otherwise(reply).alias("reply"))
    return enrichment.build_cards(groups, replies, u)


def q_build_cards(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("id", "source_type", "title", "text", "source_title", "page_start", "page_end", F.array_join("semantic_tags", ",").alias("semantic_tags"), F.array_join("card_targets", ",").alias("card_targets"), F.array_join("parent_chunk_ids", ",").alias("parents"))


SQL_CARDS = f"""{W_UNITS}, {_GROUPS}
SELECT 'ku_card_' || substring(sha256(group_id), 1, 16) AS id, a.source_type, 'card ' || group_id AS title, first AS text, book AS source_title, a.page_start, c.page_end,
  array_to_string(list_sort(list_distinct(list_concat(list_concat(a.semantic_tags, b.semantic_tags), c.semantic_tags))), ',') AS semantic_tags, 'healing' AS card_targets, concat_ws(',', first, second, third) AS parents
FROM g JOIN units a ON a.id = first JOIN units b ON b.id = second JOIN units c ON c.id = third WHERE group_no % 7 <> 0 AND group_no % 11 <> 0"""


def q_card_lineage(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.card_lineage(_cards(spark, d), units(spark, d).filter("source_status <> 'quarantined'"))


SQL_LINEAGE = f"""{W_UNITS}, {_GROUPS}, m AS (SELECT group_id, group_no, unnest([first, second, third]) AS parent_id FROM g)
SELECT 'ku_card_' || substring(sha256(group_id), 1, 16) AS card_id, parent_id, source_status <> 'quarantined' AS found FROM m JOIN units ON id = parent_id WHERE group_no % 7 <> 0 AND group_no % 11 <> 0"""


def q_apply_enrichment(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    good = F.to_json(F.struct(F.concat(F.lit("about "), "title").alias("summary"), F.array(F.lit("src0"), F.lit("none"), F.lit("en")).alias("scenario_tags")))
    replies = u.filter("source_status = 'main'").select("id", F.when(F.col("page_start") % 5 == 0, "no json").otherwise(good).alias("reply"))
    done = enrichment.apply_enrichment(u, replies, POOL | {"semantic_tags": ["x"], "risk_levels": ["low"], "card_targets": ["healing"]})
    return done.select("id", "summary", F.array_join("scenario_tags", ",").alias("scenario_tags"), F.array_join("contraindications", ",").alias("contraindications"))


SQL_ENRICH = f"""{W_UNITS}
SELECT id, CASE WHEN source_status = 'main' AND page_start % 5 <> 0 THEN 'about ' || title ELSE '' END AS summary,
  CASE WHEN source_status <> 'main' THEN array_to_string(scenario_tags, ',') WHEN page_start % 5 <> 0 THEN 'src0,en' ELSE '' END AS scenario_tags,
  CASE WHEN source_status = 'main' THEN '' ELSE array_to_string(contraindications, ',') END AS contraindications FROM units"""


def q_enrichment_requests(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return enrichment.enrichment_requests(u, u.filter("source_status = 'main'")).select("id", F.md5("prompt").alias("prompt_md5"))


def q_kb_overview(spark: SparkSession, d: str) -> DataFrame:
    return repository.kb_overview(units(spark, d), table(spark, d, "documents"))


def q_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return repository.duplicate_content(table(spark, d, "documents"))


def q_new_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".jsonl").when(F.col("lang") == "fr", ".MD").otherwise(".pdf")).alias("file_path"), "doc_id")
    registry = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select("file_path")
    return repository.detect_source_type(repository.filter_new_documents(docs, registry), "file_path")


SQL_NEW = """
SELECT '/in/' || doc_id || CASE lang WHEN 'de' THEN '.jsonl' WHEN 'fr' THEN '.MD' ELSE '.pdf' END AS file_path, doc_id, CASE lang WHEN 'de' THEN 'case' WHEN 'fr' THEN 'markdown' ELSE 'pdf_book' END AS source_type
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def q_upsert_units(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).select("id", "title", F.col("page_start").alias("updated_at"))
    incoming = u.filter("title < 'F'").withColumn("title", F.concat(F.lit("new "), "title"))
    return repository.upsert_units(u, incoming.unionByName(incoming.withColumns({"title": F.lit("old"), "updated_at": F.col("updated_at") - 1})))


def q_ingest_results(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunk_documents(pages(spark, d), "\n").withColumn("source_status", F.when(F.length("text") < 200, "quarantined").otherwise("main"))
    return repository.ingest_results(chunks, table(spark, d, "documents"))


SQL_RESULTS = f"""WITH RECURSIVE {_PIECES}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS q FROM overlapped GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS total_segments, coalesce(q, 0) AS quarantined_count, coalesce(n - q, 0) AS chunk_count, CASE WHEN n > 0 THEN 'completed' ELSE 'empty' END AS parse_status FROM documents LEFT JOIN c USING (doc_id)"""


def q_annotation_sheet(spark: SparkSession, d: str) -> DataFrame:
    return repository.export_annotation_sheet(units(spark, d), ["stupid", "trash"]).drop("text_preview")


SQL_SHEET = f"""{W_UNITS}
SELECT id AS chunk_id, source_title, page_start, array_to_string(semantic_tags, ',') AS current_semantic_tags, array_to_string(risk_levels, ',') AS current_risk_levels,
  CASE WHEN contains(text, 'stupid') OR contains(text, 'trash') OR list_contains(risk_levels, 'high') THEN 0 ELSE 1 END AS rank_group FROM units"""


def q_merge_annotations(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    sheet = u.filter("source_status = 'candidate'").select(F.col("id").alias("chunk_id"), F.when(F.col("page_start") % 2 == 0, " a, b ，c").otherwise(" ").alias("annotated_contraindications"), F.when(F.col("page_start") % 3 == 0, "medium").otherwise("").alias("annotated_risk_level"))
    return repository.merge_annotations(u, sheet).select("id", F.array_join("contraindications", ",").alias("contraindications"), F.array_join("risk_levels", ",").alias("risk_levels"))


SQL_MERGED_SHEET = f"""{W_UNITS}
SELECT id, CASE WHEN source_status <> 'candidate' THEN array_to_string(contraindications, ',') WHEN page_start % 2 = 0 THEN 'a,b,c' ELSE '' END AS contraindications,
  CASE WHEN source_status = 'candidate' AND page_start % 3 = 0 THEN 'medium' ELSE array_to_string(risk_levels, ',') END AS risk_levels FROM units"""


def q_manifest_plan(spark: SparkSession, d: str) -> DataFrame:
    web = table(spark, d, "pages").withColumn("name", F.concat(F.lit("page_"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html")))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("guideline", "article", "method_paper", " consensus ", "unheard")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("E:\\lib\\"), "name", F.when(F.col("page_id") % 2 == 0, " | 3 MB").otherwise("")))
    manifest = web.select(F.col("page_id").alias("item_id"), F.col("url").alias("title"), F.lit(None).cast("string").alias("normalized_title"), kind.alias("source_type_for_RAG"), path.alias("local_path"), F.concat(F.lit("P"), (F.col("page_id") % 4).cast("string")).alias("priority"))
    files = web.filter("page_id % 6 <> 0").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("copy of "), "name")).otherwise(F.col("name")).alias("file_name"), F.concat(F.lit("/lib/"), "name").alias("full_path"))
    return repository.plan_manifest(manifest, files)


SQL_MANIFEST = """
WITH w AS (SELECT page_id, url, '/lib/page_' || lpad(page_id::VARCHAR, 8, '0') || '.html' AS f FROM pages),
k AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 'guideline' WHEN 1 THEN 'paper' WHEN 3 THEN 'guideline' END AS st, page_id % 7 <> 0 AS has_path, page_id % 6 <> 0 AS has_file FROM w)
SELECT page_id AS item_id, url AS title, CASE WHEN st IS NOT NULL AND has_path AND has_file THEN f END AS path, st AS source_type, CASE WHEN page_id % 4 <= 1 THEN 'main' ELSE 'candidate' END AS source_status,
  CASE WHEN st IS NULL THEN 'kind' WHEN NOT has_path THEN 'no path' WHEN NOT has_file THEN 'no file' END AS reason FROM k"""


def q_validate_units(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    odd = {
        "source_status": F.when(F.col("source_title") == "src3", "lost").otherwise(F.col("source_status")),
        "source_type": F.when(F.col("source_title") == "src4", "poem").otherwise(F.col("source_type")),
        "review_status": F.when(F.col("source_title") == "src5", "seen").when(F.col("source_title") == "src6", "approved"),
        "card_targets": F.when(F.col("source_title") == "src7", F.array(F.lit("healing"), F.lit("other"))).otherwise(F.col("card_targets")),
        "created_at": F.when(F.col("source_title") != "src8", F.lit("2026-01-01T00:00:00Z")),
        "quality_score": F.col("quality_score") * 2,
    }
    return cleaning.validate_units(u.withColumns(odd))


SQL_VALIDATE = f"""{W_UNITS} SELECT id, 'source_status_unknown' AS rule FROM units WHERE source_title = 'src3' UNION ALL SELECT id, 'quality_score_out_of_range' FROM units WHERE quality_score * 2 > 1
UNION ALL SELECT id, 'source_type_unknown' FROM units WHERE source_title = 'src4' UNION ALL SELECT id, 'review_status_unknown' FROM units WHERE source_title = 'src5'
UNION ALL SELECT id, 'card_target_unknown' FROM units WHERE source_title = 'src7' UNION ALL SELECT id, 'created_at_missing' FROM units WHERE source_title IS NULL OR source_title = 'src8'"""


def q_pick_page_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).otherwise("  x ").alias("layer_text"), F.when(F.col("lang") != "fr", F.col("text")).alias("ocr_text"))
    return repository.pick_page_text(rows).select("doc_id", F.md5("text").alias("text_md5"), "parse_method", "confidence")


SQL_PICK = r"""
WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '  x ' END AS a, CASE WHEN lang <> 'fr' THEN text END AS b FROM documents),
s AS (SELECT *, length(regexp_replace(a, '^\s+|\s+$', '', 'g')) >= 50 AS e, regexp_replace(coalesce(b, ''), '^\s+|\s+$', '', 'g') <> '' AS o FROM r)
SELECT doc_id, md5(CASE WHEN e OR NOT o THEN a ELSE b END) AS text_md5, CASE WHEN o AND NOT e THEN 'ocr' ELSE 'text_layer' END AS parse_method, CASE WHEN e THEN 1.0 WHEN o THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM s"""


def q_get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return repository.get_by_ids(units(spark, d), ids).select("id", "source_status", "title")


def q_upsert_table(spark: SparkSession, d: str) -> DataFrame:
    """The same into a written table, of which only the folders of incoming ids are read and replaced."""
    u = units(spark, d).select("id", "title", F.col("page_start").alias("updated_at"))
    path = new_folder(spark)
    repository.create_units_table(u, path)
    repository.upsert_units_table(u.filter("updated_at % 500 < 3").withColumn("title", F.concat(F.lit("new "), "title")), path)
    return spark.read.parquet(path).select("id", "title", F.col("updated_at").cast("long").alias("updated_at"))


def q_units_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Quarantined units of a table that is written by status; only their folder is read."""
    path = new_folder(spark)
    repository.write_units(units(spark, d).select("id", "title", "source_status"), path)
    return cleaning.units_by_status(spark.read.parquet(path), "quarantined").select(F.col("id").cast("string").alias("id"), "title")


def q_skipped_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return repository.skipped_documents(docs, docs.filter("doc_id % 3 = 0"), "doc_id")


#: Documents of a file of lines, about.
FILE_ROWS = 20_000


def q_jsonl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as lines of JSON to eight folders by id, with a blank line after each, and read as pages that are
    numbered through a folder. Its files hold ranges of ids, so that no task has a folder's documents."""
    path = new_folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("part", F.pmod("doc_id", F.lit(8)))
    line = F.concat(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))), F.lit("\n"))
    ranges = max(8, -(-docs.count() // FILE_ROWS))
    docs.repartitionByRange(ranges, "part", "doc_id").sortWithinPartitions("part", "doc_id").select("part", line.alias("value")).write.partitionBy("part").text(path)
    pages_read = readers.read_jsonl_pages(spark, f"{path}/*/*", through=True)
    return pages_read.select(F.regexp_extract("file_path", r"part=(\d+)", 1).cast("long").alias("part"), F.col("page_number").cast("long").alias("page_number"), F.md5("text").alias("text_md5"))


QUERIES = {
    "upsert_table": q_upsert_table, "units_by_status": q_units_by_status, "skipped_documents": q_skipped_documents, "jsonl_pages": q_jsonl_pages,
    "clean_pages": q_clean_pages, "quality_flags": q_quality_flags, "quality_score": q_quality_score, "flag_duplicates": q_flag_duplicates,
    "split_paragraphs": q_segments, "merge_short": q_merge_short, "split_long": q_split_long, "chunk_documents": q_chunk_documents,
    "validate_tags": q_validate_tags, "tag_distribution": q_tag_distribution, "tag_coverage": q_tag_coverage, "enrichment_requests": q_enrichment_requests,
    "apply_enrichment": q_apply_enrichment, "card_groups": q_card_groups, "card_requests": q_card_requests, "build_cards": q_build_cards, "card_lineage": q_card_lineage,
    "kb_overview": q_kb_overview, "duplicate_content": q_duplicate_content, "new_documents": q_new_documents, "upsert_units": q_upsert_units,
    "ingest_results": q_ingest_results, "annotation_sheet": q_annotation_sheet, "merge_annotations": q_merge_annotations, "manifest_plan": q_manifest_plan,
    "validate_units": q_validate_units, "pick_page_text": q_pick_page_text, "get_by_ids": q_get_by_ids,
}
ORACLES = {
    "upsert_table": f"{W_UNITS} SELECT id, CASE WHEN page_start % 500 < 3 THEN 'new ' || title ELSE title END AS title, page_start AS updated_at FROM units",
    "units_by_status": f"{W_UNITS} SELECT id, title FROM units WHERE source_status = 'quarantined'",
    "skipped_documents": "SELECT doc_id, 'skipped' AS parse_status FROM documents WHERE doc_id % 3 = 0",
    "jsonl_pages": "SELECT doc_id % 8 AS part, 2 * row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS page_number, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "clean_pages": f"SELECT doc_id, md5({_CLEAN}) AS text_md5, length({_CLEAN})::INT AS n FROM documents",
    "quality_flags": SQL_FLAGS,
    "quality_score": SQL_SCORE,
    "flag_duplicates": SQL_DUPLICATES,
    "split_paragraphs": f"WITH {_SEGMENTS} SELECT doc_id, segment_no, md5(text) AS text_md5 FROM segments",
    "merge_short": f"WITH RECURSIVE {_MERGED} SELECT doc_id, group_no, md5(text) AS text_md5, length(text)::INT AS n FROM merged",
    "split_long": SQL_SPLIT,
    "chunk_documents": SQL_CHUNKS,
    "validate_tags": f"{W_UNITS} SELECT id, {_in('scenario_tags')}, {_in('role_tags')} FROM units",
    "tag_distribution": f"{W_UNITS} SELECT tag, count(*) AS n FROM (SELECT unnest(scenario_tags) AS tag FROM units) GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
    "tag_coverage": f"{W_UNITS} SELECT source_type, count(*) AS n_units, round(avg(CASE WHEN len(contraindications) > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM units GROUP BY source_type",
    "enrichment_requests": f"{W_UNITS} SELECT id, md5('Text:' || chr(10) || substring(text, 1, 2000)) AS prompt_md5 FROM units WHERE source_status <> 'main'",
    "apply_enrichment": SQL_ENRICH,
    "card_groups": f"{W_UNITS}, {_GROUPS} SELECT * FROM g",
    "card_requests": SQL_CARD_REQUESTS,
    "build_cards": SQL_CARDS,
    "card_lineage": SQL_LINEAGE,
    "kb_overview": f"{W_UNITS} SELECT 'source_status' AS dimension, source_status AS value, count(*) AS n FROM units GROUP BY 2 UNION ALL SELECT 'unit_type', unit_type, count(*) FROM units GROUP BY 2 UNION ALL SELECT 'source_type', source_type, count(*) FROM units GROUP BY 2 UNION ALL SELECT 'documents', 'all', count(*) FROM documents",
    "duplicate_content": "SELECT doc_id, content_hash, first FROM (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents) WHERE doc_id > first",
    "new_documents": SQL_NEW,
    "upsert_units": f"{W_UNITS} SELECT id, CASE WHEN title < 'F' THEN 'new ' || title ELSE title END AS title, page_start AS updated_at FROM units",
    "ingest_results": SQL_RESULTS,
    "annotation_sheet": SQL_SHEET,
    "merge_annotations": SQL_MERGED_SHEET,
    "manifest_plan": SQL_MANIFEST,
    "validate_units": SQL_VALIDATE,
    "pick_page_text": SQL_PICK,
    "get_by_ids": f"{W_UNITS} SELECT id, source_status, title FROM units WHERE id IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)",
}
