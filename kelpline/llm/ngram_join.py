"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bitsets import gather_bits
from .common import partitions, stash, table, text_of
from .components import components
from .words import Bits, hashes_of, in_slices, sequence_key, shingles, words_in

#: Words of a shingle; sets link at a Jaccard similarity of NUMERATOR / DENOMINATOR.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: At most this many tokens are known to be frequent: those with at least 1 / FREQUENT of all tokens.
FREQUENT = 1 << 20
#: The most shared prefix tokens that a set may ask for, and what verifying the sets that share a token costs against
#: pairing it with them.
MOST_MATCHES, VERIFY_COST = 4, 8.0
#: Rows of a frequent token that meet in one group; a more frequent one is dealt to several.
GROUP_ROWS = 4_096
#: Tokens ahead of a posting that it carries.
AHEAD = 8
#: Shared prefix tokens from which a group's first set is compared at once. This only saves work: all other candidates
#: between components are compared afterwards.
EARLY_MATCHES = 3


@dataclass
class Order:
    """The global order of tokens: those not known to be frequent by hash, then the frequent by count and hash."""

    tokens: np.ndarray
    counts: np.ndarray

    def count_of(self, tokens: np.ndarray) -> np.ndarray:
        """The known count of frequent tokens, 0 for all others."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


def least_overlap(n: int) -> int:
    """Tokens that a set of ``n`` shares at least with any set that it links to."""
    return -(-n * NUMERATOR // DENOMINATOR)


def prefix(tokens: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The longest prefix that a sorted token set may need, in the global order, and the known counts of its tokens.

    With m matches asked for, a set's prefix has n - least_overlap + m tokens: two linked sets share m of the first so
    many if both ask for m or more. How many a set asks for is decided when the tokens' counts are known (``_asking``)."""
    counts = order.count_of(tokens)
    n = len(tokens)
    must = least_overlap(n)
    taken = np.argsort(counts, kind="stable")[: n - must + min(MOST_MATCHES, must)]  # tokens are sorted
    return tokens[taken], counts[taken]


#: Bits of a sketch for each token, about, and the most as a power of two.
SKETCH_BITS, MOST_SKETCH = 4, 20


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens at each of a power of two of places."""
    bits = 1 << min(MOST_SKETCH, max(6, (SKETCH_BITS * len(tokens)).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Tokens that are in one of two sets only, at least: places with another parity. The longer sketch is folded."""
    if len(a) < len(b):
        a, b = b, a
    one, other, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        one = (one >> bits) ^ (one & ((1 << bits) - 1))
    return (one ^ other).bit_count()


PROFILE = "doc_id long, key binary, n_shingles long, sketch binary, token long, n long"
_PROFILE = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.binary()), ("token", pa.int64()), ("n", pa.int64())])


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, key, n_shingles, sketch) for each text, and for each slice rows (token, n) of the tokens that several of its
    distinct sets have, with how many."""
    for batch in in_slices(batches, "text"):
        keys, sets = [], {}
        for text in batch.column("text").to_pylist():
            hashes = hashes_of(words_in(text, lower=True))
            keys.append(sequence_key(hashes))
            if keys[-1] not in sets:
                sets[keys[-1]] = shingles(hashes)
        tokens, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = counts > 1
        n, m = len(keys), int(often.sum())
        sizes, sketches = [len(sets[k]) for k in keys], {k: sketch(t) for k, t in sets.items()}
        none = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([sketches[k] for k in keys], pa.binary()), none(n, pa.int64()), none(n, pa.int64())], schema=_PROFILE)
        if m:
            yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.binary()), none(m, pa.int64()), none(m, pa.binary()), pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], schema=_PROFILE)


#: facts is the set's size * 2 ** 24 + the token's place in its prefix; the part is 0 but for tokens dealt to several
#: groups.
PREFIX = "token long, part int, doc_id long, facts long"


def _firsts(batches: Iterable[pa.RecordBatch], gone: Bits, back: Bits) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        marks = batch.column("mark").to_numpy().view(np.uint64)
        yield batch.filter(pa.array(~gone.has(marks) | back.has(marks)))


def _among(batches: Iterable[pa.RecordBatch], gone: Bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["mark"]).filter(pa.array(gone.has(batch.column("mark").to_numpy().view(np.uint64))))


def _prefix_rows(batches: Iterable[pa.RecordBatch], order: Order) -> Iterator[pa.RecordBatch]:
    """The prefix of each row, but of those that have the words of an earlier one in the task and no smaller id: the least
    id of a word sequence always has its prefix, whatever comes first."""
    seen: dict[bytes, int] = {}
    for batch in in_slices(batches, "text"):
        out: list[tuple[np.ndarray, ...]] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = hashes_of(words_in(text, lower=True))
            if not len(hashes) or seen.get(key := sequence_key(hashes), doc_id + 1) <= doc_id:
                continue
            seen[key] = doc_id
            tokens = shingles(hashes)
            kept, counts = prefix(tokens, order)
            parts = counts // GROUP_ROWS
            own = int.from_bytes(key[:4], "little")
            part = np.where(parts > 1, 1 + own % np.maximum(parts, 1), 0)
            out.append((kept.view(np.int64), part.astype(np.int32), np.full(len(kept), doc_id, np.int64), (len(tokens) << 24) + np.arange(len(kept))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "part", "doc_id", "facts"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts a_text and b_text link."""
    last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        links: list[tuple[int, int]] = []
        for a, b, a_text, b_text in zip(*(batch.column(c) for c in ("a", "b", "a_text", "b_text")), strict=True):
            if last[0] != a.as_py():
                last = (a.as_py(), shingles(hashes_of(words_in(a_text.as_py(), lower=True))))
            other = shingles(hashes_of(words_in(b_text.as_py(), lower=True)))
            shared = len(np.intersect1d(last[1], other, assume_unique=True))
            if shared and DENOMINATOR * shared >= NUMERATOR * (len(last[1]) + len(other) - shared):
                links.append((a.as_py(), b.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])


def _marked(batches: Iterable[pa.RecordBatch], wanted: Bits) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        mask = wanted.has(batch.column("mark").to_numpy().view(np.uint64))
        yield batch.select(["doc_id", "text"]).filter(pa.array(mask))


def _may_link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for a_n, b_n, a, b in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True):
            shared = -(-(a_n + b_n) * NUMERATOR // (NUMERATOR + DENOMINATOR))
            kept.append(least_difference(a, b) <= a_n + b_n - 2 * shared)
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def unlike_left_out(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs (a, b) but for those whose sketches differ at more places than linked sets of their sizes can. Sketches are
    a fraction of the texts that the rest is compared by."""
    side = lambda x: profile.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInArrow(_may_link, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts link, as (u, v). Only texts of ids in a pair that sketches leave are shuffled."""
    pairs = stash(unlike_left_out(pairs, profile))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = gather_bits(ids.select(F.xxhash64("id").alias("mark")))
    marked = docs.withColumn("mark", F.xxhash64("doc_id"))
    texts = stash(marked.mapInArrow(lambda b: _marked(b, wanted.value), "doc_id long, text string"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(_compare, "u long, v long").distinct()


def frequent_tokens(counted: DataFrame, n_tokens: int) -> Order:
    """Tokens of ``counted`` (token, n) with 1 / FREQUENT of all tokens or more, so FREQUENT at most. Slices tell the tokens
    that several of their sets have, so a count may lack one for each slice; the order is the same for all sets, which is
    all that results depend on."""
    least = max(2, -(-n_tokens // FREQUENT))
    found = counted.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    at = np.argsort(tokens)
    return Order(tokens[at], counts[at].astype(np.int64))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); other columns are ignored.

    Words are runs of characters other than space and U+0009 to U+000D, A to Z in lower case. A row's set is its distinct
    shingles of SHINGLE words; a shorter text is one shingle; a text without words, or null, has an empty set and links
    to nothing. Rows link when 100 * intersection >= 75 * union. component_id is the smallest id reachable, its own
    included. Rows with the same id are one document; a row with a null id carries no links, but has the component of
    rows with its words. No rows give no rows.

    Copies share a class before anything is compared. Each class sends its prefix to groups by token. In a group the
    first set is compared with the others first, which joins most near copies into components; then only pairs of
    different components that share enough prefix tokens are compared, first by sketches. So a large group of near copies costs its size
    rather than its square, and no link between components is left out. Sets are compared whole, by 64-bit hashes of
    their shingles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    told = stash(rows.mapInArrow(_profile, PROFILE))
    profile = told.filter("key IS NOT NULL").select("doc_id", "key", "n_shingles")
    sketches = told.filter("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "sketch")
    named = rows.filter("doc_id IS NOT NULL")
    n_tokens = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    classes = profile.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    members = stash(profile.join(classes, "key", "left").select("doc_id", "n_shingles", "class_id"))
    # Copies are left out by a filter of bounded size. What it leaves out beyond them is taken in again; a copy that comes
    # in with it is compared like any other set.
    mark = F.xxhash64("doc_id").alias("mark")
    gone = gather_bits(members.filter("doc_id <> class_id").select(mark))
    wrongly = members.filter("doc_id = class_id").select(mark).mapInArrow(lambda b: _among(b, gone.value), "mark long")
    back = gather_bits(wrongly)

    order = docs.sparkSession.sparkContext.broadcast(frequent_tokens(told.filter("token IS NOT NULL").select("token", "n"), n_tokens))
    marked = named.withColumn("mark", F.xxhash64("doc_id"))
    emitted = marked.mapInArrow(lambda b: _prefix_rows(_firsts(b, gone.value, back.value), order.value), PREFIX)
    group = W.partitionBy("token", "part")
    met = (
        emitted.repartition(partitions(docs.sparkSession), "token", "part")
        .withColumns({"low": F.min("doc_id").over(group), "high": F.max("doc_id").over(group), "n": F.count("*").over(group)})
        .filter("low < high OR part > 0")
    )
    postings = stash(_asking(met.select("token", "part", F.col("doc_id").alias("id"), "facts", "n")))

    early = stash(_early_pairs(postings))
    links = stash(verified(early, named, sketches))
    joined = components(links).select(F.col("node").alias("id"), "component")
    late = _late_pairs(postings, joined).join(early, ["a", "b"], "left_anti")
    links = links.unionByName(verified(late, named, sketches))
    found = components(links).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    own = members.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return own.join(found, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))


def _size(facts: str) -> Column:
    return F.shiftright(F.col(facts), 24)


def _place(facts: str) -> Column:
    return F.col(facts).bitwiseAND(F.lit((1 << 24) - 1))


def _least_overlap(n: Column) -> Column:
    return F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR)


def _overlap(a: Column, b: Column) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    both = NUMERATOR + DENOMINATOR
    return F.floor(((a + b) * NUMERATOR + both - 1) / both)


def _asking(met: DataFrame) -> DataFrame:
    """``met`` (token, part, id, facts, n) with what a set learns when its tokens are counted: asks, the matches m that it
    asks for; and the AHEAD tokens before it in the prefix that other prefixes have, too. A prefix that is longer by a
    token meets the sets that have this token, too, and in return fewer reach m matches. The sets met in the prefix for a
    partner of its own size, from the counts n of all data, times (1 + VERIFY_COST / m ** 2) estimate the cost of m; the
    m with the least is taken."""
    size, own = _size("facts"), W.partitionBy("id")
    costs = []
    for m in range(1, MOST_MATCHES + 1):
        meets = F.sum(F.when(_place("facts") < size - _overlap(size, size) + m, F.col("n") - 1).otherwise(0)).over(own)
        costs.append(F.when(_least_overlap(size) >= m, F.struct((meets * (1 + VERIFY_COST / m**2)).alias("cost"), F.lit(m).alias("m"))))
    ahead = [F.lag("token", k).over(own.orderBy("facts", "token")) for k in range(1, AHEAD + 1)]
    return met.withColumns(
        {
            "asks": F.array_min(F.array(*costs))["m"],
            "ahead": F.array_compact(F.array(*ahead)),
        }
    )


def _near(one: str, other: str) -> Column:
    """Whether the sizes let two sets link."""
    a, b = _size(one), _size(other)
    return (DENOMINATOR * F.least(a, b)) >= (NUMERATOR * F.greatest(a, b))


def _in_pair_prefix(matches: Column, one: str, other: str) -> Column:
    """Whether the token is in the prefix that the pair's sizes leave to either set. Linked sets share _overlap of their
    tokens, so a set may have size - overlap tokens that the other lacks, and its m-th match is among the first so many +
    m. That no other *prefix* has a token says nothing of the sets, so it shortens no prefix."""
    a, b = _size(f"{one}_facts"), _size(f"{other}_facts")
    fits = [_place(f"{x}_facts") < n - _overlap(a, b) + matches for x, n in ((one, a), (other, b))]
    return fits[0] & fits[1]


def _early_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of a group's first set with others that meet it EARLY_MATCHES times in the prefix that a pair of their sizes
    has, and of the first sets of a token's groups."""
    own = F.struct("id", "facts", "asks")
    side = lambda x, of: [F.col(f"{of}{c}").alias(f"{x}_{c}") for c in ("id", "facts", "asks")]
    first = F.first(own).over(W.partitionBy("token", "part").orderBy("id", "facts"))
    met = postings.withColumn("first", first).select(*side("a", "first."), *side("b", ""))
    heads = postings.filter("part > 0").groupBy("token", "part").agg(F.min(own).alias("head"))
    top = heads.groupBy("token").agg(F.min("head").alias("top"))
    tops = heads.join(top, "token").select(*side("a", "top."), *side("b", "head."))
    pairs = met.unionByName(tops).filter("a_id < b_id").filter(_near("a_facts", "b_facts") & _in_pair_prefix(F.least("a_asks", "b_asks"), "a", "b"))
    return pairs.groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= EARLY_MATCHES).select("a", "b")


def _late_pairs(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs of different components that share as many prefix tokens as the less demanding of the two asks for.

    A token's sets in the component that most of them have are paired with the others only, never among themselves. Sets
    that share many tokens meet at the first few: at a token where they can see as many earlier matches as are asked
    for, they pass."""
    size = _size("facts")
    placed = (
        postings.filter(_place("facts") < size - _least_overlap(size) + F.col("asks"))
        .join(joined, "id", "left")
        .select("token", "id", "facts", "asks", "ahead", F.coalesce("component", "id").alias("component"))
    )
    placed = stash(placed)
    shares = placed.groupBy("token", "component").agg(F.count("*").alias("n"))
    main = shares.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("n")).filter("n > 1")
    live = placed.join(stash(main.select("token", "main")), "token")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "facts", "asks", "ahead", "component")]
    a = live.filter("component <> main").select("token", *side("a"))
    b = live.select("token", *side("b"), (F.col("component") == F.col("main")).alias("b_main"))
    asks = F.least("a_asks", "b_asks")
    pairs = (
        a.join(b, "token")
        .filter("a_component <> b_component AND (b_main OR a_id < b_id)")
        .filter(_near("a_facts", "b_facts") & _in_pair_prefix(asks, "a", "b"))
        .filter(F.size(F.array_intersect("a_ahead", "b_ahead")) < asks)
    )
    sides = [F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")]
    return pairs.groupBy(*sides).agg(F.count("*").alias("n"), F.min(asks).alias("asks")).filter("n >= asks").select("a", "b")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text) whose id is the smallest of their component, with its columns; rows with
    a null id stay. Only rows that a filter of bounded size takes for dropped ones are shuffled."""
    dropped = stash(link_components(docs).filter("doc_id <> component_id").select("doc_id").distinct())
    bits = gather_bits(dropped.select(F.xxhash64("doc_id").alias("mark")))

    @F.pandas_udf("boolean")
    def may_go(marks: pd.Series) -> pd.Series:
        return pd.Series(bits.value.has(marks.to_numpy().view(np.uint64)))

    # The row travels as one column, so that its names can't clash with ours.
    own_id = F.col("doc_id").cast("long")
    marked = docs.select(F.struct(*docs.columns).alias("row"), own_id.alias("doc_id")).withColumn("may_go", may_go(F.xxhash64("doc_id")))
    stay = marked.filter("NOT may_go OR doc_id IS NULL").select("row.*")
    doubtful = marked.filter("may_go AND doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").select("row.*")
    return stay.unionByName(doubtful)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
