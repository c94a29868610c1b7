"""Sharding by best-fit-decreasing bin packing over indivisible groups of equal texts."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, table, text_of

#: Bits of a group's size that count: groups with equal ones are a class of about one size. Sizes up to 4,095 bytes are
#: classes of their own, larger ones differ from their class by less than 1 / 2,048. A class is all that the packing sees
#: of its groups, so the driver gets a few thousand rows (2 ** 11 for each power of two of sizes) whatever the corpus
#: holds.
SIZE_BITS = 12
#: Rows that one task numbers.
SLOT_ROWS = 50_000


@dataclass
class _Node:
    key: tuple[int, int]
    rank: bytes
    left: _Node | None = field(default=None)
    right: _Node | None = field(default=None)


class CapacityTree:
    """A balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, remaining: int, bin_: int) -> None:
        rank = blake2b(f"{remaining}:{bin_}".encode(), digest_size=8).digest()
        low, high = self._cut(self.root, (remaining, bin_))
        self.root = self._glue(self._glue(low, _Node((remaining, bin_), rank)), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the least remaining capacity that still holds ``size``."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best:
            low, rest = self._cut(self.root, best)
            _, high = self._cut(rest, (best[0], best[1] + 1))
            self.root = self._glue(low, high)
        return best

    def _cut(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._cut(node.right, key)
            return node, high
        low, node.left = self._cut(node.left, key)
        return low, node

    def _glue(self, low: _Node | None, high: _Node | None) -> _Node | None:
        if low is None or high is None:
            return low or high
        if low.rank > high.rank:
            low.right = self._glue(low.right, high)
            return low
        high.left = self._glue(low, high.left)
        return high


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Where the items of each class (equal ``sizes``, ``counts`` of them) go: runs (bin, number). Items by falling size
    enter the tightest bin that holds them, or open a new one; as the items of a class are alike, a bin that was the
    tightest takes as many as it holds. An item above the capacity gets a bin of its own."""
    runs: list[list[tuple[int, int]]] = [[] for _ in sizes]
    tree, opened = CapacityTree(), 0
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        left = counts[at]
        while left:
            found = tree.tightest(sizes[at])
            remaining, bin_ = found if found else (max(capacity, sizes[at]), opened)
            opened += not found
            n = min(left, remaining // sizes[at])
            runs[at].append((bin_, n))
            tree.add(remaining - n * sizes[at], bin_)
            left -= n
    return runs


def into_fixed_bins(sizes: list[int], counts: list[int], n_bins: int) -> list[list[tuple[int, int]]]:
    """Best fit decreasing into at most ``n_bins`` bins at the least capacity that bisection finds. Items above a fair
    share of what is left take a bin each, so that they don't raise the capacity of the others."""
    runs: list[list[tuple[int, int]]] = [[] for _ in sizes]
    rest = sorted((i for i in range(len(sizes)) if counts[i]), key=lambda i: (-sizes[i], i))
    own = list(counts)
    left, total, taken = n_bins, sum(s * c for s, c in zip(sizes, counts, strict=True)), 0
    while rest and left > 1 and sizes[rest[0]] * left > total:
        runs[rest[0]].append((taken, 1))
        total -= sizes[rest[0]]
        own[rest[0]] -= 1
        left, taken = left - 1, taken + 1
        if not own[rest[0]]:
            rest.pop(0)
    if not rest:
        return runs
    some, many = [sizes[i] for i in rest], [own[i] for i in rest]
    bins = lambda packed: max(b for r in packed for b, _ in r) + 1
    low, high = max(some[0], -(-total // left)), some[0] + -(-total // left)
    packed = best_fit_decreasing(some, many, high)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(some, many, middle)
        if bins(tried) <= left:
            packed, high = tried, middle
        else:
            low = middle + 1
    for at, found in zip(rest, packed, strict=True):
        runs[at] += [(taken + b, n) for b, n in found]
    return runs


def _class(size: Column) -> Column:
    """The size without the bits beyond its first SIZE_BITS."""
    drop = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (SIZE_BITS - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def _digests(docs: DataFrame) -> DataFrame:
    """row (all columns), t (the text), size and key of each row of ``docs``."""
    own = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("t"))
    return own.withColumns({"size": (F.octet_length("t") + 1).cast("long"), "key": F.unhex(F.sha2("t", 256))})


def group_shards(rows: DataFrame, n_shards: int = 16) -> DataFrame:
    """key and shard of every distinct key (a digest of a text) of ``rows`` (key, size). Groups of equal texts are counted
    by class of size, classes are packed, and the groups of a class are dealt out in the order of their digests: they are
    numbered in chunks, so that a class of any number of groups takes many tasks."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("class", _class(F.col("bytes")))
    groups = stash(groups.withColumn("chunk", F.conv(F.substring(F.hex("key"), 1, 3), 16, 10).cast("int")))  # 4,096 chunks in order of digests
    chunks = stash(groups.groupBy("class", "chunk").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    classes = chunks.groupBy("class").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).orderBy("class").collect()
    runs = into_fixed_bins([-(-x["bytes"] // x["n"]) for x in classes], [x["n"] for x in classes], n_shards)
    spans = [(x["class"], start, start + n, shard) for x, own in zip(classes, runs, strict=True) for start, n, shard in _spans(own)]
    placed = spark.createDataFrame(spans, "class long, low long, high long, shard int")
    before = W.partitionBy("class").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = chunks.select("class", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("class", "chunk").orderBy("key")) - 1
    numbered = groups.withColumn("number", number).join(starts, ["class", "chunk"]).withColumn("place", F.col("start") + F.col("number"))
    spans_of = placed.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("high", "shard"))).alias("spans"))
    dealt = numbered.join(F.broadcast(spans_of), "class")  # n_shards spans a class at most
    return dealt.select("key", F.filter("spans", lambda s: s["high"] > F.col("place"))[0]["shard"].alias("shard"))


def _spans(runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, number, shard) of runs one after another; runs of one shard are joined."""
    joined: dict[int, int] = {}
    for shard, n in runs:
        joined[shard] = joined.get(shard, 0) + n
    out, start = [], 0
    for shard, n in sorted(joined.items()):
        out.append((start, n, shard))
        start += n
    return out


def assign_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text); others are ignored.

    The size is the text's UTF-8 bytes plus 1; equal texts (null counts as empty) share a shard. A group above an
    even share of the bytes has a shard to itself, as groups are indivisible. Groups are packed by their sizes; shards
    differ by about the size of the smallest groups, plus 1 / 2,048 of the bytes of groups above 4,095 bytes at most. Rows
    with equal or null ids each have a row; no rows give no rows. Texts are read but never shuffled; rows travel as a digest
    of some 60 bytes.
    """
    rows = stash(_digests(docs).withColumn("text_crc32", F.crc32(F.encode("t", "UTF-8"))).select("row.doc_id", "size", "text_crc32", "key"))
    shards = stash(group_shards(rows, n_shards))
    n_chunks = max(1, -(-rows.count() // SLOT_ROWS))
    placed = rows.join(shards, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_chunks)).cast("int").alias("chunk"))
    placed = stash(placed)
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    own = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("own", own)
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write all rows and columns of ``docs`` (with text) as one folder a shard, shard=0 and so on; rows are found by the
    digest of their text, so nulls and repeated ids lose and add nothing. A column of ``docs`` named shard is replaced."""
    own = _digests(docs)
    shards = stash(group_shards(own.select("key", "size"), n_shards))
    kept = [F.col(f"row.{c}") for c in docs.columns if c != "shard"]
    own.join(shards, "key").select(*kept, "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
