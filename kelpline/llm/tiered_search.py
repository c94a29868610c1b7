"""Ranked lexical search over a tiered index: postings of high impact first, lower tiers only where the residual bounds of
an item's terms don't prove its best documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, join_small, stash, table
from .words import in_slices

TOP = 10
#: A tier ends with the impact level at which it and those above have so many postings of a term; the last has the rest.
QUOTAS = (256, 4_096, 65_536)
#: Levels that impacts, below IMPACTS, are counted in. A term's tiers are whole levels.
LEVELS, IMPACTS = 256, 1_000_000
#: An item's candidates whose whole scores set its threshold. Any number of them gives the same results.
FIRST = 64
#: The most terms that are sent to tasks as a set; with more, every term of the documents is indexed.
MOST_TERMS = 1 << 18
#: Bytes of a term's row, and of a pair of an item and a document.
TERM_BYTES, PAIR_BYTES = 96, 24

#: Bytes of terms: digits, letters (A to Z as lower case) and all of characters beyond ASCII. Others separate terms.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def key_of(term: bytes) -> int:
    """64 bits that a term is known by."""
    return int.from_bytes(blake2b(term, digest_size=8).digest(), "little", signed=True)


def _item_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(i, t, key_of(t)) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in sorted(set(terms_in(text or "")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("item_id").type), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], ["item_id", "term", "key"])


def _forward_rows(batches: Iterable[pa.RecordBatch], keys: dict[bytes, int] | None) -> Iterator[pa.RecordBatch]:
    """row (a number of its own), doc_id, n, keys and tfs of each text with a term; of the terms in ``keys``, or of all."""
    row = TaskContext.get().partitionId() << 40
    for batch in in_slices(batches, "text"):
        ids, sizes, ends, terms, counts = [], [], [0], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = Counter(terms_in(text.as_py() or ""))
            if not found:
                continue
            ids.append(doc_id)
            sizes.append(found.total())
            own = [(k, tf) for t, tf in found.items() if (k := keys.get(t)) is not None] if keys is not None else [(key_of(t), tf) for t, tf in found.items()]
            terms += [k for k, _ in own]
            counts += [tf for _, tf in own]
            ends.append(len(terms))
        of = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), of(terms), of(counts)], ["row", "doc_id", "n", "keys", "tfs"])
        row += len(ids)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


@dataclass
class TieredIndex:
    """forward: row, doc_id, n, keys, tfs. postings: row, key, impact, tier. terms: key, w, and bounds, the highest impact that
    is left of a term when 0, 1, ... tiers of it have been read. n_docs documents have n_terms terms."""

    forward: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int

    def impact(self, tf: Column, n: Column) -> Column:
        return impact_of(tf, n, self.n_docs, self.n_terms)


def impact_of(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What a term that a document of ``n`` terms has ``tf`` times adds to its score for each unit of weight."""
    m = 100 - 90 + _div(n * F.lit(90 * n_docs).cast("long"), F.lit(max(n_terms, 1)).cast("long"))
    return _div(tf * F.lit(1_000_000_000).cast("long"), tf * 1_000 + m * 8)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, key: the distinct terms of each item (item_id, text); those of rows with one id together."""
    rows = items.filter("item_id IS NOT NULL").select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(_item_rows, f"item_id {kind}, term binary, key long").distinct()


def build_index(docs: DataFrame, wanted: DataFrame | None = None) -> TieredIndex:
    """The index of every row of ``docs`` (doc_id, text), of the terms in ``wanted`` (term, key), or of all terms where there
    are too many to send to tasks. Statistics are of all documents with a term and of all their terms.

    A posting's tier follows from the impact levels of its term, which are counted by Spark, so a term that most
    documents have isn't sorted in one place. Postings stay where their documents are, and are written by tier.
    """
    spark = docs.sparkSession
    keys = None
    if wanted is not None:
        distinct = stash(wanted.select("term", "key").distinct())
        if distinct.count() <= MOST_TERMS:
            keys = {bytes(r["term"]): r["key"] for r in distinct.collect()}
    shared = spark.sparkContext.broadcast(keys)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    forward = stash(slim.mapInArrow(lambda b: _forward_rows(b, shared.value), "row long, doc_id long, n long, keys array<long>, tfs array<long>"))
    sums = forward.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = sums["n_docs"], sums["n_terms"]
    each = forward.select("row", "n", F.explode(F.arrays_zip("keys", "tfs")).alias("z")).select("row", F.col("z.keys").alias("key"), impact_of(F.col("z.tfs"), F.col("n"), n_docs, n_terms).alias("impact"))
    each = each.withColumn("level", _div(F.col("impact") * LEVELS, F.lit(IMPACTS)).cast("int"))
    levels = stash(each.groupBy("key", "level").agg(F.count("*").alias("n"), F.max("impact").alias("top")))
    above = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tiers = levels.withColumn("above", above).withColumn("tier", reduce(lambda a, q: a + (F.col("above") >= q).cast("int"), QUOTAS, F.lit(0)))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.sum("n") + 1).cast("double")))
    left = lambda read: F.coalesce(F.max(F.when(F.col("tier") >= read, F.col("top"))), F.lit(0))
    first = [F.coalesce(F.min(F.when(F.col("tier") <= t, F.col("level"))), F.lit(LEVELS)) for t in range(len(QUOTAS))]
    terms = stash(tiers.groupBy("key").agg(weight.alias("w"), F.array(*[left(t) for t in range(len(QUOTAS) + 2)]).alias("bounds"), F.array(*first).alias("first")))
    joined = join_small(each, terms.select("key", "first"), "key", TERM_BYTES * terms.count(), ["row"], "inner")
    tier = reduce(lambda a, t: a + (F.col("level") < F.col("first")[t]).cast("int"), range(len(QUOTAS)), F.lit(0))
    postings = joined.select("row", "key", "impact", tier.alias("tier")).sortWithinPartitions("tier", "key")
    return TieredIndex(forward, stash(postings, "tier"), terms.select("key", "w", "bounds"), n_docs, n_terms)


def whole_scores(index: TieredIndex, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, row, doc_id, score of ``pairs`` (item_id, row), over all terms that an item has (``asked``: item_id and all_terms,
    an array of key and w)."""
    near = F.broadcast(pairs) if PAIR_BYTES * pairs.count() <= MOST_BROADCAST else pairs
    rows = index.forward.join(near, "row").join(asked, "item_id")
    # A term that isn't there is at place 0, so its tf is that of the place before the first: null.
    places = F.transform("all_terms", lambda t: F.struct(t["w"].alias("w"), F.get("tfs", F.array_position("keys", t["key"]).cast("int") - 1).alias("tf")))
    gains = F.transform(F.filter(places, lambda t: t["tf"].isNotNull()), lambda t: t["w"] * index.impact(t["tf"], F.col("n")))
    return rows.select("item_id", "row", "doc_id", F.aggregate(gains, F.lit(0).cast("long"), lambda a, g: a + g).alias("score"))


def _thresholds(index: TieredIndex, hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item_id, least: the ``k``-th best whole score of the FIRST documents with the best sums of ``hits``; of items with so
    many documents."""
    sums = hits.groupBy("item_id", "row").agg(F.sum("gain").alias("gain"))
    best = sums.withColumn("_rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("gain"), "row"))).filter(F.col("_rank") <= FIRST)
    scored = whole_scores(index, stash(best.select("item_id", "row")), asked)
    ranked = scored.withColumn("_rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "row")))
    return ranked.filter(F.col("_rank") == k).select("item_id", F.col("score").alias("least"))


def search(index: TieredIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item (item_id, term, key of
    item_terms); equal scores by doc_id, null last.

    Round after round a tier is read of the terms that an item still needs. Whole scores of the best documents so far give
    the item's threshold. What its terms may still add to a document that none of the read postings names is at most
    the sum of weight times residual bound; terms are left at the tier they have reached, the lowest bounds first,
    while their sum stays below the threshold. Where that holds of all terms, the item is proven; the others
    fall through to the next tier, and after the last one nothing is left. Then every named document whose sum and
    bounds reach the threshold is scored whole. A threshold only decides how much is read.
    """
    state = items.select("item_id", "key").join(index.terms, "key")
    state = stash(state.select("item_id", "key", "w", "bounds", F.lit(0).alias("read"), F.lit(True).alias("open")))
    asked = stash(state.groupBy("item_id").agg(F.collect_list(F.struct("key", "w")).alias("all_terms")))
    hits, least = None, None
    bound = F.col("w") * F.get("bounds", F.col("read"))
    for tier in range(len(QUOTAS) + 1):
        if tier:
            # Terms that were left stay so; of the open ones those go first that have the least to add.
            order = W.partitionBy("item_id").orderBy("open", bound, "key").rowsBetween(W.unboundedPreceding, W.currentRow)
            told = state.join(least, "item_id", "left").withColumn("sum", F.sum(bound).over(order))
            still = F.col("open") & (bound > 0) & (F.col("sum") >= F.coalesce("least", F.lit(0)))
            state = stash(told.select("item_id", "key", "w", "bounds", "read", still.alias("open")))
        needed = state.filter("open").select("key", "item_id", "w")
        n_needed = needed.count()
        if not n_needed:
            break
        own = index.postings.filter(F.col("tier") == tier).select("row", "key", "impact")
        near = F.broadcast(needed) if TERM_BYTES * n_needed <= MOST_BROADCAST else needed
        found = stash(own.join(near, "key").select("item_id", "row", "key", (F.col("w") * F.col("impact")).alias("gain")))
        hits = found if hits is None else hits.unionByName(found)
        state = state.withColumn("read", F.col("read") + F.col("open").cast("int"))
        least = stash(_thresholds(index, hits, asked, k))
    if hits is None:
        hits = state.select("item_id", F.lit(0).cast("long").alias("row"), "key", F.col("w").alias("gain")).limit(0)
        least = state.select("item_id", F.col("w").alias("least")).limit(0)
    bounds = state.select("item_id", "key", bound.alias("bound"))
    rest = bounds.groupBy("item_id").agg(F.sum("bound").alias("rest")).join(least, "item_id", "left")
    reach = hits.join(F.broadcast(bounds) if TERM_BYTES * bounds.count() <= MOST_BROADCAST else bounds, ["item_id", "key"])
    reach = reach.groupBy("item_id", "row").agg(F.sum(F.col("gain") - F.col("bound")).alias("more")).join(rest, "item_id")
    pairs = stash(reach.filter(F.col("more") + F.col("rest") >= F.coalesce("least", F.lit(0))).select("item_id", "row"))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = whole_scores(index, pairs, asked).filter("score > 0").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` of ``items`` (item_id, text) over all rows of ``docs`` (doc_id, text), by an index of their terms.

    Terms are runs of digits, letters and all characters beyond ASCII, A to Z in lower case. A null text has none; an item
    without any, or of which no document has one, has no rows. Rows with equal or null ids are documents of their own.
    Items with a null id are left out; other columns are ignored.
    """
    terms = stash(item_terms(items))
    return search(build_index(docs, terms), terms, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH tokens AS (SELECT doc_id, {_TERMS} AS t FROM documents),
docs AS (SELECT doc_id, t, len(t) AS n FROM tokens WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
posts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posts, totals GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN posts USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
