"""Recall routes, snippets and query preparation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.lexicon import SAFETY_RULES
from kelpline.functions.text import tokens
from kelpline.operators.indexing import document_frequencies, in_buckets
from kelpline.operators.matching import contained, first_units, named_units
from kelpline.operators.storage import stash

#: Most query vectors and other vectors of a block, about, and how many of the latter are scored at a time.
QUERY_BLOCK, ROW_BLOCK, SLICE = 4_096, 16_384, 2_048
#: Units of a block of postings, about; sums, and gains that are added up, that a task holds at a time, about; distinct tokens
#: of queries that are broadcast.
UNIT_BLOCK, SUMS, MOST_GAINS, MOST_TOKENS = 8_192, 1 << 22, 1 << 22, 1 << 20
K1, B = 1.2, 0.75


def _pairs(requests: DataFrame, name: str) -> Column:
    """The entries of the map ``name`` as "key=value, ...", by key; null where there are none or no such column."""
    if name not in requests.columns:
        return F.lit(None).cast("string")
    entries = F.array_sort(F.map_entries(name))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    return F.when(F.size(name) > 0, text)


def analysis_requests(requests: DataFrame) -> DataFrame:
    """query_id and prompt. The lines of the maps risk_assessment and dyadic_analysis are there where these aren't empty."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Patient: "), F.coalesce("patient_text", F.lit(""))),
        F.concat(F.lit("Family: "), F.coalesce("family_text", F.lit(""))),
        F.concat(F.lit("Risk: "), _pairs(requests, "risk_assessment")),
        F.concat(F.lit("Dyadic: "), _pairs(requests, "dyadic_analysis")),
    )
    return requests.select("query_id", lines.alias("prompt"))


def prepare_queries(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Requests with their analysis: missing arrays are empty, missing or empty rewrites are the patient's text."""
    names = [c for c in analyses.columns if c not in ("query_id", "rewritten_queries")]
    joined = requests.join(analyses, "query_id", "left")
    empty = F.expr("cast(array() AS array<string>)")
    rewrites = F.when(F.coalesce(F.size("rewritten_queries"), F.lit(0)) > 0, F.col("rewritten_queries")).otherwise(F.array("patient_text"))
    return joined.withColumns({c: F.coalesce(c, empty) for c in names} | {"rewritten_queries": rewrites})


def rewrites(queries: DataFrame) -> DataFrame:
    """query_id, rewrite_no, text."""
    return queries.select("query_id", F.posexplode("rewritten_queries").alias("rewrite_no", "text"))


def _best(scores: Iterator[tuple[int, np.ndarray]], k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the ``k`` best of each row of a matrix above ``least``, with those that tie once rounded; of
    the matrix a slice of columns at a time."""
    rows, columns, values = [], [], []
    for start, part in scores:
        taken = min(k, part.shape[1])
        edge = np.partition(part, part.shape[1] - taken, axis=1)[:, part.shape[1] - taken]
        q, u = np.nonzero((part >= edge[:, None] - 1e-6) & (part > least))
        rows.append(q)
        columns.append(u + start)
        values.append(part[q, u])
    q, u, v = map(np.concatenate, (rows, columns, values))
    order = np.lexsort((-v, q))
    q, u, v = q[order], u[order], v[order]
    first = np.searchsorted(q, q)  # where the row's values begin
    last = np.minimum(first + k - 1, np.searchsorted(q, q, "right") - 1)
    kept = v >= v[last] - 1e-6
    return q[kept], u[kept], v[kept]


def _cross_recall(queries: DataFrame, rows: DataFrame, k: int, least: float, dense: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """query_id, unit_id, score, pos of all ``queries`` (query_id, rewrite_no and their vectors) over ``rows`` (unit_id and
    theirs). Up to QUERY_BLOCK queries are broadcast, and rows meet them where they are read. More of them and rows are dealt
    to blocks of a bounded size, and each block of the ones meets each of the others in a task. Either keeps the best ``k``
    for each query; each side is read once."""
    asked = stash(queries.withColumn("rewrite_no", F.col("rewrite_no").cast("int")))
    n_queries = asked.count()
    unit, query = rows.schema["unit_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found_schema = f"query_id {query}, rewrite_no int, unit_id {unit}, score double"

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        one, other = one.combine_chunks(), other.combine_chunks()
        if not one.num_rows or not other.num_rows:
            at = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            matrix = dense(one)
            at = _best(((start, matrix @ dense(other.slice(start, SLICE)).T) for start in range(0, other.num_rows, SLICE)), k, least)
        return pa.table({"query_id": one["query_id"].take(pa.array(at[0])), "rewrite_no": one["rewrite_no"].take(pa.array(at[0])), "unit_id": other["unit_id"].take(pa.array(at[1])), "score": pa.array(at[2])})

    if n_queries <= QUERY_BLOCK:
        shared = queries.sparkSession.sparkContext.broadcast(asked.toArrow())

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from meet(shared.value, pa.Table.from_batches([batch])).to_batches()

        found = rows.mapInArrow(past, found_schema)
    else:
        query_blocks, row_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-rows.count() // ROW_BLOCK))
        each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        own = lambda n, name, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias(name)
        asked = asked.select("*", own(query_blocks, "_q", "query_id", "rewrite_no"), each(row_blocks, "_r"))
        dealt = rows.select("*", own(row_blocks, "_r", "unit_id"), each(query_blocks, "_q"))
        found = asked.groupBy("_q", "_r").cogroup(dealt.groupBy("_q", "_r")).applyInArrow(meet, found_schema)
    found = found.withColumn("score", F.round("score", 6))
    top = W.partitionBy("query_id", "rewrite_no").orderBy(F.desc("score"), "unit_id")
    return first_hits(found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k))


def dense_recall(queries: DataFrame, vectors: DataFrame, k: int = 50) -> DataFrame:
    """query_id, unit_id, score, pos: the exact ``k`` best inner products of each rewrite (query_id, rewrite_no,
    embedding) over ``vectors`` (unit_id, embedding), scores to 6 places and ties by unit; of a unit that several rewrites
    find, the first one's hit."""
    flat = lambda part: part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
    asked = queries.filter("embedding IS NOT NULL").select("query_id", "rewrite_no", "embedding")
    return _cross_recall(asked, vectors.filter("embedding IS NOT NULL").select("unit_id", "embedding"), k, -np.inf, flat)


def first_hits(hits: DataFrame) -> DataFrame:
    """query_id, unit_id, score, pos: the first hit of each unit in order of rewrite_no and rank, and its place."""
    first = W.partitionBy("query_id", "unit_id").orderBy("rewrite_no", "rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rewrite_no", "rank"))
    return kept.select("query_id", "unit_id", "score", place.alias("pos"))


def _scattered(at: pa.ListArray, weight: pa.ListArray, width: int) -> np.ndarray:
    """Rows of places and weights as a matrix."""
    out = np.zeros((len(at), width))
    out[np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = weight.flatten().to_numpy()
    return out


def sparse_dot_recall(query_vectors: DataFrame, unit_vectors: DataFrame, width: int, k: int = 50) -> DataFrame:
    """As dense_recall over (query_id, rewrite_no, at, weight) and (id, at, weight), places below ``width`` and weights in two
    arrays: units that share no place aren't returned. Rows are laid out in slices where they are scored."""
    whole = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lambda part: _scattered(whole(part["at"]), whole(part["weight"]), width)
    rows = unit_vectors.select(F.col("id").alias("unit_id"), "at", "weight")
    return _cross_recall(query_vectors.select("query_id", "rewrite_no", "at", "weight"), rows, k, 0.0, flat)


def bm25_weights(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of the rewrites (query_id, rewrite_no, token, times, df, null for one that no unit has, and blocks), and the
    weighed postings of these tokens: token, unit_id, w, block. Units are dealt to ``blocks`` blocks of some UNIT_BLOCK. Up to
    MOST_TOKENS distinct tokens are broadcast, so that other postings end where they are counted or read."""
    totals = stats.first()  # one row
    tokens_of = queries.select("query_id", "rewrite_no", F.explode(tokens(F.col("text"))).alias("token"))
    q = stash(tokens_of.groupBy("query_id", "rewrite_no", "token").agg(F.count("*").alias("times")))
    asked = q.select("token").distinct()
    if "buckets" in stats.columns:
        postings = in_buckets(postings, asked, totals["buckets"])
    asked = F.broadcast(asked) if asked.count() <= MOST_TOKENS else asked
    near = stash(postings.select("token", "id", "tf", "len").join(asked, "token", "left_semi"))
    df = stash(document_frequencies(near))
    raw = F.log((F.lit(totals["n_units"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(raw > 0, raw).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(totals["avg_len"])))
    blocks = max(1, -(-totals["n_units"] // UNIT_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    known = near.join(df, "token").select("token", F.col("id").alias("unit_id"), weight.alias("w"), block.alias("block"))
    return stash(q.join(df, "token", "left").withColumn("blocks", F.lit(blocks))), known


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A code for each value, and the values by code; null is a value."""
    encoded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _sums(n_queries: int, unit: np.ndarray, n_units: int, w: np.ndarray, first: np.ndarray, n: np.ndarray, query: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of all queries over units, of as many units at a time as SUMS sums and MOST_GAINS gains allow. Postings are
    ordered by ``unit``; posting i meets the ``n[i]`` rows of queries from ``first[i]`` on."""
    gains = np.concatenate([[0], np.cumsum(n)])
    ends = np.searchsorted(unit, np.arange(n_units), "right")
    start, wide = 0, max(1, SUMS // n_queries)
    while start < n_units:
        low = ends[start - 1] if start else 0
        last = int(np.searchsorted(gains[ends], gains[low] + MOST_GAINS, "right"))  # units up to here have that many gains
        stop = min(n_units, start + wide, max(start + 1, last))
        high = ends[stop - 1]
        size = n[low:high]
        at = np.repeat(first[low:high] - (gains[low:high] - gains[low]), size) + np.arange(gains[high] - gains[low])
        where = query[at] * (stop - start) + np.repeat(unit[low:high] - start, size)
        total = np.bincount(where, np.repeat(w[low:high], size) * times[at], n_queries * (stop - start))
        yield start, total.reshape(n_queries, stop - start)
        start = stop


def or_hits(q: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """query_id, rewrite_no, unit_id, gain: of each block of units the ``k`` that are best for a rewrite, those that tie once
    rounded too, with their whole scores. Rewrites are dealt to blocks as well; a block of postings meets each block of rewrites
    in a task, and sums stay there: what is shuffled is the postings, not what each of them gives to each rewrite."""
    own = ["query_id", "rewrite_no"]
    query_blocks = max(1, -(-q.select(*own).distinct().count() // QUERY_BLOCK))
    asked = q.filter("df IS NOT NULL").select(*own, "token", "times", F.pmod(F.xxhash64(*own), F.lit(query_blocks)).cast("int").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = known.select("token", "unit_id", "w", "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"))
    unit, query = known.schema["unit_id"].dataType.simpleString(), q.schema["query_id"].dataType.simpleString()

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        at, keys, units = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), one.select(own), other["unit_id"].combine_chunks()
        if one.num_rows and other.num_rows:
            (ids, _), (numbers, known_numbers) = (_codes(one[c]) for c in own)
            _, sample, query_of = np.unique(ids * len(known_numbers) + numbers, return_index=True, return_inverse=True)
            keys = keys.take(pa.array(sample))
            asks, words = _codes(one["token"])
            order = np.argsort(asks, kind="stable")
            begins, ends = (np.searchsorted(asks[order], np.arange(len(words)), side) for side in ("left", "right"))
            other = other.append_column("_t", pc.index_in(other["token"], words))
            other = other.filter(pc.is_valid(other["_t"]))
            codes, units = _codes(other["unit_id"])
            if len(units):
                by_unit = np.argsort(codes, kind="stable")
                token = other["_t"].to_numpy()[by_unit]
                sums = _sums(len(sample), codes[by_unit], len(units), other["w"].to_numpy()[by_unit], begins[token], (ends - begins)[token], query_of[order], one["times"].to_numpy()[order].astype(np.float64))
                at = _best(sums, k, 0.0)
        found = keys.take(pa.array(at[0]))
        return pa.table({"query_id": found["query_id"], "rewrite_no": found["rewrite_no"], "unit_id": units.take(pa.array(at[1])), "gain": pa.array(at[2])})

    number = q.schema["rewrite_no"].dataType.simpleString()
    return asked.groupBy("_q", "block").cogroup(dealt.groupBy("_q", "block")).applyInArrow(meet, f"query_id {query}, rewrite_no {number}, unit_id {unit}, gain double")


def and_hits(q: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, rewrite_no, unit_id, gain of the postings of units that have a rewrite's rarest token: only these may have
    all. A rewrite with a token that no unit has gets none."""
    own = ["query_id", "rewrite_no"]
    rarest = q.groupBy(*own).agg(F.min(F.struct("df", "token")).alias("r"), F.count_if(F.col("df").isNull()).alias("absent")).filter("absent = 0")
    units = rarest.select(*own, F.col("r.token").alias("token")).join(known.select("token", "unit_id"), "token").drop("token")
    return units.join(q.select(*own, "token", "times"), own).join(known, ["token", "unit_id"]).select(*own, "unit_id", (F.col("w") * F.col("times")).alias("gain"))


def bm25_recall(queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int = 30, op: str = "and") -> DataFrame:
    """query_id, unit_id, score, pos of the ``k`` best units of each rewrite (query_id, rewrite_no, text): those with all
    of its tokens (op "and") or any ("or"). The score is negative, and less is better: minus the sum over the query's
    tokens, repeats counted again, of idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len / avg_len)), where idf is
    ln((N - n + .5) / (n + .5)), or 1e-6 if that isn't positive. Postings are first cut to the queries' tokens, those of a
    written index by buckets; what they give is summed up by blocks of units, or taken of the rarest tokens' units only
    (``or_hits``, ``and_hits``)."""
    q, known = bm25_weights(queries, postings, stats)
    hits = and_hits(q, known) if op == "and" else or_hits(q, known, k)
    scored = hits.groupBy("query_id", "rewrite_no", "unit_id").agg(F.round(-F.sum("gain"), 6).alias("score"), F.count("*").alias("n"))
    if op == "and":
        wanted = q.groupBy("query_id", "rewrite_no").agg(F.count("*").alias("distinct_tokens"))
        scored = scored.join(wanted, ["query_id", "rewrite_no"]).filter("n = distinct_tokens")
    top = W.partitionBy("query_id", "rewrite_no").orderBy("score", "unit_id")
    return first_hits(scored.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k))


def highlight_snippet(hits: DataFrame, units: DataFrame, queries: DataFrame, width: int = 40) -> DataFrame:
    """query_id, unit_id, snippet: of each hit the first window of ``width`` tokens with the most matches, matches in
    <mark>, with ... where text is left out. Only for final hits, whose texts are joined by id."""
    wanted = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_wanted"))
    hits = stash(hits.select("query_id", "unit_id"))
    rows = hits.join(named_units(units, hits).select(F.col("id").alias("unit_id"), tokens(F.col("text")).alias("_t")), "unit_id").join(wanted, "query_id")
    each = rows.select("query_id", "unit_id", "_wanted", F.size("_t").alias("_n"), F.posexplode("_t").alias("_pos", "_token"))
    window = W.partitionBy("query_id", "unit_id").orderBy("_pos").rowsBetween(0, width - 1)
    counted = each.withColumn("_s", F.sum(F.array_contains("_wanted", F.col("_token")).cast("int")).over(window))
    whole = counted.filter((F.col("_pos") == 0) | (F.col("_pos") + width <= F.col("_n")))
    starts = whole.groupBy("query_id", "unit_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), (F.col("_pos") + 1).alias("at"))).alias("_b"))
    best = rows.join(starts.select("query_id", "unit_id", F.col("_b.at").alias("_at")), ["query_id", "unit_id"])
    shown = F.transform(F.slice("_t", F.col("_at"), F.lit(width)), lambda t: F.when(F.array_contains("_wanted", t), F.concat(F.lit("<mark>"), t, F.lit("</mark>"))).otherwise(t))
    before, after = F.when(F.col("_at") > 1, "...").otherwise(""), F.when(F.col("_at") + width - 1 < F.size("_t"), "...").otherwise("")
    return best.select("query_id", "unit_id", F.concat(before, F.array_join(shown, " "), after).alias("snippet"))


def search_by_tags(wanted: DataFrame, units: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """key, unit_id, pos: of each key the first ``limit`` active units by id with an element of ``field`` that contains
    one of its tags (key, tag), whatever the case. The distinct tags meet the distinct elements by a gram
    (``matching.contained``), and only the first units of an element are joined to the keys."""
    active = units.filter(F.col("source_status").isin("main", "candidate")).select(F.col("id").alias("unit_id"), F.explode(field).alias("element"))
    elements = active.select("unit_id", F.lower("element").alias("hay")).filter("hay IS NOT NULL")
    tags = wanted.select("key", F.lower("tag").alias("needle")).distinct()
    pairs = contained(tags, elements).join(tags, "needle").select("key", "hay").distinct()
    found = first_units(elements, pairs, limit)
    return found.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("unit_id"))).filter(F.col("pos") <= limit)


def metadata_recall(queries: DataFrame, units: DataFrame, k: int = 20) -> DataFrame:
    """query_id, unit_id, score, pos: units by scenario tags (.5), then by roles (.4); the first hit of a unit counts."""
    scenario = queries.select(F.col("query_id").alias("key"), F.explode("scenario_tags").alias("tag"))
    role = queries.select(F.col("query_id").alias("key"), F.explode("role_focus").alias("tag"))
    one = search_by_tags(scenario, units, "scenario_tags", k).withColumns({"rewrite_no": F.lit(0), "score": F.lit(0.5)})
    two = search_by_tags(role, units, "role_tags", k).withColumns({"rewrite_no": F.lit(1), "score": F.lit(0.4)})
    both = one.unionByName(two).withColumnsRenamed({"key": "query_id", "pos": "rank"})
    return first_hits(both)


def safety_recall(queries: DataFrame, units: DataFrame, rules: Mapping[str, Sequence[str]] = SAFETY_RULES, per_keyword: int = 10) -> DataFrame:
    """query_id, unit_id, score, boost, pos: units whose contraindications contain a keyword of a signal. Contraindication
    signals come before risk signals; a signal without a rule is its own keyword."""
    spark = queries.sparkSession
    listed = spark.createDataFrame([(s, i, k) for s, ks in rules.items() for i, k in enumerate(ks)], "signal string, keyword_no int, keyword string")
    signals = queries.select("query_id", F.posexplode(F.concat("contraindication_signals", "risk_signals")).alias("signal_no", "signal"))
    keywords = signals.join(F.broadcast(listed), "signal", "left").select("query_id", "signal_no", F.coalesce("keyword_no", F.lit(0)).alias("keyword_no"), F.coalesce("keyword", "signal").alias("keyword"))
    found = search_by_tags(keywords.select(F.col("keyword").alias("key"), F.col("keyword").alias("tag")).distinct(), units, "contraindications", per_keyword)
    hits = keywords.join(found, keywords["keyword"] == found["key"]).select("query_id", "unit_id", F.lit(1.0).alias("score"), (F.col("signal_no") * 100_000 + F.col("keyword_no")).alias("rewrite_no"), F.col("pos").alias("rank"))
    return first_hits(hits).withColumn("boost", F.lit(0.2))
