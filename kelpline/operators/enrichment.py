"""Tags, model replies joined as tables, and cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import TAG_POOL
from kelpline.functions.text import preview

REPLY = "struct<summary:string, semantic_tags:array<string>, scenario_tags:array<string>, role_tags:array<string>, method_tags:array<string>, risk_levels:array<string>, card_targets:array<string>>"
CARD = "struct<title:string, text:string, card_targets:array<string>>"


def validate_tags(rows: DataFrame, pools: Mapping[str, Sequence[str]] = TAG_POOL) -> DataFrame:
    """Only tags of the pool of their column, in order and with repeats; columns without a pool are untouched."""

    def known(column: str) -> Column:
        pool = list(pools[column])
        return F.filter(column, lambda t: t.isin(pool))

    return rows.withColumns({c: known(c) for c in rows.columns if c in pools})


def enrichment_requests(units: DataFrame, done: DataFrame, chars: int = 2000) -> DataFrame:
    todo = units.join(done.select("id").distinct(), "id", "left_anti")
    return todo.select("id", F.concat(F.lit("Text:\n"), preview(F.col("text"), chars)).alias("prompt"))


def apply_enrichment(units: DataFrame, replies: DataFrame, pools: Mapping[str, Sequence[str]] = TAG_POOL) -> DataFrame:
    """Units with summary and tags of their JSON reply (id, reply); a bad reply leaves them empty, and contraindications
    are emptied as well. Units without a reply stay as they are."""
    parsed = validate_tags(replies.select("id", F.from_json("reply", REPLY).alias("r")).select("id", "r.*"), pools)
    tags = [c for c in TAG_POOL if c in units.columns]
    own = parsed.select("id", F.coalesce("summary", F.lit("")).alias("_summary"), *[F.coalesce(c, F.expr("cast(array() AS array<string>)")).alias(f"_{c}") for c in tags])
    joined = units.join(own, "id", "left")
    replaced = {"summary": F.coalesce("_summary", "summary")} | {c: F.coalesce(f"_{c}", c) for c in tags}
    if "contraindications" in units.columns:
        replaced["contraindications"] = F.when(F.col("_summary").isNotNull(), F.expr("cast(array() AS array<string>)")).otherwise(F.col("contraindications"))
    return joined.withColumns(replaced).select(*units.columns)


def tag_distribution(units: DataFrame, field: str, k: int = 10) -> DataFrame:
    """tag and n of the ``k`` most frequent, ties by tag."""
    return units.select(F.explode(field).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def card_groups(chunks: DataFrame) -> DataFrame:
    """book, group_no, group_id and the ids of three consecutive chunks of a book, every second one starting a group;
    only whole triples. Chunks are in order of pages, then id."""
    order = W.partitionBy("source_title").orderBy("page_start", "page_end", "id")
    placed = chunks.withColumns({"n": F.row_number().over(order), "second": F.lead("id", 1).over(order), "third": F.lead("id", 2).over(order)})
    kept = placed.filter("(n - 1) % 2 = 0 AND third IS NOT NULL")
    ends = [F.substring(c, F.greatest(F.length(c) - 7, F.lit(1)), F.lit(8)) for c in (F.col("id"), F.col("second"), F.col("third"))]
    return kept.select(F.col("source_title").alias("book"), ((F.col("n") - 1) / 2).cast("long").alias("group_no"), F.concat_ws("+", *ends).alias("group_id"), F.col("id").alias("first"), "second", "third")


def _members(groups: DataFrame) -> DataFrame:
    return groups.select("group_id", F.posexplode(F.array("first", "second", "third")).alias("place", "id"))


def card_requests(groups: DataFrame, chunks: DataFrame, done: DataFrame, chars: int = 500) -> DataFrame:
    """group_id and prompt (the members' first characters) of groups that aren't done."""
    todo = groups.join(done.select("group_id").distinct(), "group_id", "left_anti")
    members = _members(todo).join(chunks.select("id", preview(F.col("text"), chars).alias("part")), "id")
    parts = F.sort_array(F.collect_list(F.struct("place", "part")))
    return members.groupBy("group_id").agg(parts.alias("p")).select("group_id", F.concat(F.lit("Source chunks:\n"), F.array_join(F.col("p.part"), "\n\n")).alias("prompt"))


def build_cards(groups: DataFrame, replies: DataFrame, chunks: DataFrame, targets: Sequence[str] = tuple(TAG_POOL["card_targets"])) -> DataFrame:
    """Card units of the replies (group_id, reply) that have a title and a text, with the union of the parents' semantic
    tags, the first parent's source and start and the last one's end."""
    parsed = replies.select("group_id", F.from_json("reply", CARD).alias("r")).select("group_id", "r.*")
    good = parsed.filter("coalesce(title, '') <> '' AND coalesce(text, '') <> ''")
    parents = chunks.select("id", F.col("source_type").alias("parent_type"), "page_start", "page_end", "semantic_tags")
    members = _members(groups).join(parents, "id")
    merged = members.groupBy("group_id").agg(
        F.min_by("parent_type", "place").alias("source_type"),
        F.min_by("page_start", "place").alias("page_start"),
        F.max_by("page_end", "place").alias("page_end"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("semantic_tags")))).alias("semantic_tags"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda m: m["id"]).alias("parent_chunk_ids"),
    )
    known = F.filter(F.coalesce("card_targets", F.expr("cast(array() AS array<string>)")), lambda t: t.isin(list(targets)))
    cards = good.join(merged, "group_id").join(groups.select("group_id", "book"), "group_id")
    return cards.select(
        F.concat(F.lit("ku_card_"), F.substring(F.sha2("group_id", 256), 1, 16)).alias("id"), F.lit("knowledge_card").alias("unit_type"), "source_type",
        F.lit("main").alias("source_status"), "title", "text", F.col("book").alias("source_title"), "page_start", "page_end", "semantic_tags",
        F.array(F.lit("nurse")).alias("role_tags"), known.alias("card_targets"), F.lit(0.9).alias("quality_score"), "parent_chunk_ids",
    )


def card_lineage(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """card_id, parent_id, found: a row for each parent; cards without parents have one with a null parent."""
    parents = cards.select(F.col("id").alias("card_id"), F.explode_outer("parent_chunk_ids").alias("parent_id"))
    known = chunks.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    return parents.join(known, "parent_id", "left").select("card_id", "parent_id", F.coalesce("_known", F.lit(False)).alias("found"))


def tag_coverage(units: DataFrame, fields: Sequence[str] = ("semantic_tags", "scenario_tags")) -> DataFrame:
    """source_type and the share of its units with any tag."""
    tagged: Column = F.greatest(*[F.coalesce(F.size(f), F.lit(0)) for f in fields], F.lit(0)) > 0
    return units.groupBy("source_type").agg(F.count("*").alias("n_units"), F.round(F.avg(tagged.cast("double")), 6).alias("coverage"))
