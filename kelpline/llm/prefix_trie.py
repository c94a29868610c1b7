"""Conversation prefix trie by smallest-member ownership, and what sharing its prefixes saves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stash, table

#: A conversation begins with up to HEADS - 1 turns of the first one of its HUNDRED.
HEADS, HUNDRED = 6, 100
#: Turns that one window sums up; a longer conversation is several blocks.
BLOCK = 4_096
#: Characters of a text that order turns of equal numbers and roles, before its digest does.
TIE_CHARS = 64
#: Bytes of ids that are hashed at a time.
CHUNK_BYTES = 1 << 20

NODE = ["depth", "x1", "x2"]


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from another."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("long")


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation in this task, which come in order; counted from 1."""
    last, seen = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        first = np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        at = np.arange(len(ids)) - first + 1
        if ids[0] == last:
            at[first == 0] += seen
        last, seen = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place in the conversation from 1), digest, n_chars of the turns. Turns are sorted over all tasks, so that
    a long conversation is in several; only its edges are joined, at most two rows a task."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    spark = conversations.sparkSession
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("begin"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.char_length(text).cast("long").alias("n_chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "begin", "digest", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    slim = dealt.select("conv_id", "digest", "n_chars", F.spark_partition_id().alias("task"))
    placed = stash(slim.mapInArrow(_numbered, "conv_id long, digest string, n_chars long, task int, at long"))
    # A conversation in several tasks is the last one of a task and the first of the next: two at most for each task.
    per_task = placed.groupBy("conv_id", "task").agg(F.max("at").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    carried = per_task.withColumn("before", before).filter("before > 0").select("conv_id", "task", "before")
    joined = placed.join(F.broadcast(carried), ["conv_id", "task"], "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("k"), "digest", "n_chars")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: turns (conv_id, depth, digest, n_chars), and one row (conv_id, n_turns) each. A conversation
    is the first turns of the first one of its hundred (all that there are, if fewer; none if that isn't there), and its
    own turns but for as many."""
    counts = stash(turns.groupBy("conv_id").agg(F.max("k").alias("n_own")).withColumn("h", heads_of(F.col("conv_id"))))
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    lengths = counts.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    planned = counts.withColumn("base", base).join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    planned = stash(planned.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))
    heads = turns.filter(F.col("k") < HEADS).filter(F.col("conv_id") % HUNDRED == 0).withColumnRenamed("conv_id", "base")
    taken = planned.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("k <= taken").select("conv_id", F.col("k").alias("depth"), "digest", "n_chars")
    own = turns.filter(F.col("k") > heads_of(F.col("conv_id"))).join(planned.select("conv_id", "h", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_chars")
    return taken.unionByName(own), planned.select("conv_id", "n_turns")


def occurrences(rebuilt: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2, p1, p2, n_chars, before: each conversation's path from the root. A prefix is known by its depth
    and 128 bits: the exclusive or of its turns' hashes, each with its depth; p1 and p2 are its parent's. ``before`` are
    the characters of the path above. Windows see BLOCK turns of a conversation; what earlier blocks sum to is joined."""
    block = F.floor(F.col("depth") / BLOCK)
    rows = rebuilt.withColumns({"h1": F.xxhash64("depth", "digest"), "h2": F.xxhash64("digest", "depth", F.lit("second")), "block": block})
    upto = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumns({"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto), "upto": F.sum("n_chars").over(upto)})
    blocks = rebuilt.withColumns({"h1": F.xxhash64("depth", "digest"), "h2": F.xxhash64("digest", "depth", F.lit("second")), "block": block}).groupBy("conv_id", "block")
    totals = blocks.agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("n_chars").alias("bn"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[f(c).over(earlier).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bn"))]).filter("block > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = summed.join(carried, ["conv_id", "block"], "left").withColumns({"x1": F.col("x1").bitwiseXOR(zero("b1")), "x2": F.col("x2").bitwiseXOR(zero("b2")), "upto": F.col("upto") + zero("bn")})
    path = joined.select(
        "conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"),
        "n_chars", (F.col("upto") - F.col("n_chars")).alias("before"),
    )
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "x1", "x2", "p1", "p2", "n_chars", "before")]
    return path.unionByName(conversations.select("conv_id", *nothing))


def _hashed_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node's run of ids, which come in order, texts of up to CHUNK_BYTES with the first id."""
    held: list[str] = []
    node: tuple = ()
    first, size = 0, 0
    out: list[tuple] = []
    names = [*NODE, "first", "ids"]
    emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)
    for batch in batches:
        for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if held and (tuple(key) != node or size > CHUNK_BYTES):
                out.append((*node, first, ",".join(held)))
                held, size = [], 0
                if len(out) >= 1_000 or len(out[-1][-1]) > CHUNK_BYTES // 2:
                    yield emit()
                    out = []
            if not held:
                node, first = tuple(key), conv_id
            held.append(str(conv_id))
            size += len(held[-1]) + 1
    if held:
        out.append((*node, first, ",".join(held)))
    if out:
        yield emit()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node, from its texts in order; a text at a time is held."""
    node, running = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if tuple(key) != node:
                if running:
                    out.append((*node, running.hexdigest()))
                node, running = tuple(key), sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [*NODE, "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if i == 3 else pa.int64()) for i, v in enumerate((*node, running.hexdigest()))], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """NODE, ends_sha256: SHA-256 of the decimal ids of ``ends`` (NODE, conv_id) of a node, ascending and joined by commas. A
    node's ids are sorted and written as text in many tasks; only the digest, which runs from the first byte to the last,
    is one task's, and it holds one such text at a time."""
    n = partitions(ends.sparkSession)
    order = [*NODE, "conv_id"]
    texts = stash(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_hashed_runs, "depth long, x1 long, x2 long, first long, ids string"))
    return texts.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text): conv_id (the
    smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; of equal numbers by role, the first TIE_CHARS characters of the text and its
    digest, and equal ones stay as many turns. A null role or text is empty; rows without a conv_id belong to no
    conversation and are left out. No rows give no rows; other columns are ignored.

    A node is owned by its smallest member. As members only get fewer along a path, a conversation owns a suffix of its
    path, which begins where a window over each prefix finds it first. So a member's share of a node's sums follows from
    its own path: the characters from the node on, less those from where its own nodes begin; a child if the next node is
    its own; a leaf if its last node is one. One group-by of all prefixes adds these up.
    """
    rebuilt, counted = rebuild(ordered_turns(conversations))
    path = stash(occurrences(rebuilt, counted))
    # The rank filter is applied before the shuffle, too: a prefix that all share sends a row for each task.
    smallest = W.partitionBy(*NODE).orderBy("conv_id")
    owned = stash(path.withColumn("_rank", F.row_number().over(smallest)).filter("_rank = 1").drop("_rank"))
    inner = owned.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).distinct()
    leaves = owned.join(inner, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    begins = owned.groupBy("conv_id").agg(F.min("depth").alias("begin"), F.min("before").alias("above"))
    whole = path.groupBy("conv_id").agg(F.max(F.col("before") + F.col("n_chars")).alias("all_chars"))
    facts = counted.join(whole, "conv_id").join(begins, "conv_id", "left").join(leaves, "conv_id", "left")
    facts = stash(
        facts.select(
            "conv_id", "n_turns", F.coalesce("begin", F.col("n_turns") + 1).alias("begin"),
            F.coalesce("above", "all_chars").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        )
    )
    member = path.select("conv_id", "depth", "x1", "x2", "before").join(facts, "conv_id")
    child = ((F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("begin"))).cast("long")
    saved = F.greatest(F.col("above") - F.col("before"), F.lit(0))
    nodes = member.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    # The parent of all but the first of its own nodes is a conversation's own, too.
    tops = owned.filter("depth > 0").join(begins.select("conv_id", F.col("begin").alias("depth")), ["conv_id", "depth"])
    tops = tops.select(*NODE, (F.col("depth") - 1).alias("pd"), "p1", "p2")
    above = owned.select(F.col("depth").alias("pd"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    parents = tops.join(above, ["pd", "p1", "p2"]).select(*NODE, "parent")
    ends = ends_digests(path.join(counted.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*NODE, "conv_id"))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return nodes.join(parents, NODE, "left").join(ends, NODE, "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 in DuckDB: a table of 256 values, folded over the bytes of the id.
_CRC = """
bits AS (SELECT b, 0 AS step, b::BIGINT AS c FROM range(256) r(b)),
crc_table AS (WITH RECURSIVE t AS (SELECT b, step, c FROM bits UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE step < 8) SELECT list(c ORDER BY b) AS t FROM t WHERE step = 8),
convs AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table)"""
SQL = f"""
WITH {_CRC},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substring(coalesce(text, ''), 1, 64)) AS k FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, max(k) AS n FROM turns GROUP BY conv_id),
plan AS (SELECT c.conv_id, h, c.conv_id - c.conv_id % 100 AS base, least(h, coalesce(n, 0)) AS taken FROM convs c LEFT JOIN lengths l ON l.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (SELECT p.conv_id, k AS depth, role, text FROM plan p JOIN turns t ON t.conv_id = p.base AND k <= taken UNION ALL SELECT p.conv_id, k - h + taken, role, text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND k > h),
paths AS (SELECT conv_id, depth, length(text) AS n, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv_id) = depth AS is_end FROM paths),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, any_value(up) AS up, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end) AS ends FROM steps GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
sums AS (SELECT s.node, s.depth, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.n)::BIGINT AS saved_tokens FROM known k JOIN steps s ON s.conv_id = k.conv_id AND s.depth <= k.depth GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN sums s ON s.node = k.node AND s.depth = k.depth LEFT JOIN nodes p ON p.node = k.up AND p.depth = k.depth - 1"""
