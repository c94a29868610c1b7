"""Best-fit packing by patterns: repeat counts of few-document length patterns are fitted to the histogram of lengths by
non-negative least squares, rounded down, and what is left fills the holes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_small, stash, table, text_of
from .packing import MAX_LENGTH, PieceIds, default_tokenizer

END = 1
#: Length classes that patterns are made of, and the most documents of a pattern.
CLASSES, MOST_DOCUMENTS = 128, 4
#: Bytes of a row that says how many pieces of a length the tasks before have.
BASE_BYTES = 24
PIECES = "doc_id long, piece int, start long, length long, input_ids binary"


def _pieces(batches: Iterable[pa.RecordBatch], path: str, longest: int) -> Iterator[pa.RecordBatch]:
    known, end = PieceIds.of(path), np.array([END], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "input_ids"]
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = known.text(text.as_py()) + end
            for piece, start in enumerate(range(0, len(ids) // 4, longest)):
                own = ids[4 * start : 4 * (start + longest)]
                out.append((doc_id, piece, start, len(own) // 4, own))
            held += len(ids)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def token_pieces(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH) -> DataFrame:
    """doc_id, piece, start, length, input_ids (little-endian unsigned 32-bit) of every row: the ids of its text and END, cut
    into pieces of ``longest``; the last one may be shorter. A null or empty text is END alone."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, longest), PIECES)


def _numbered(batches: Iterable[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """The rows with this task's number and each row's place among those of its length in the task."""
    task, seen = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        if len(lengths) and not 0 < lengths.min() <= lengths.max() <= longest:
            raise ValueError(f"lengths must be between 1 and {longest}")
        order = np.argsort(lengths, kind="stable")
        runs = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0]) if len(order) else order
        sizes = np.diff(np.r_[runs, len(order)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(runs, sizes)
        place += seen[lengths]
        seen[lengths[order[runs]]] += sizes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(order), task, np.int64)), pa.array(place)], [*batch.schema.names, "_task", "_place"])


def patterns(classes: int = CLASSES, most: int = MOST_DOCUMENTS) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` with up to ``most`` parts, largest part first."""

    def fill(rest: int, largest: int, parts: int) -> Iterator[tuple[int, ...]]:
        if rest <= largest:
            yield (rest,)
        if parts > 1:
            for part in range(min(largest, rest - 1), -(-rest // parts) - 1, -1):
                for others in fill(rest - part, part, parts - 1):
                    yield (part, *others)

    return list(fill(classes, classes, most))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: the column that helps most enters, and those that would turn negative
    leave. At most three times as many entries as ``a`` has rows: a fit that ends before leaves more to the residual."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside[best] = True
        while True:
            at = np.flatnonzero(inside)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            down = y <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - y[down], 1e-300))
            x[at] += step * (y - x[at])
            inside[at[x[at] <= 1e-12 * max(1.0, np.abs(b).max())]] = False
            x[~inside] = 0
    return x


#: A group of alike sequences: how many, tokens used in each, and runs (length, first place, pieces in each).
Group = tuple[int, int, list[tuple[int, int, int]]]


def _part(group: Group, start: int, n: int) -> Group:
    """``n`` of a group's sequences from ``start`` on."""
    return n, group[1], [(length, first + start * m, m) for length, first, m in group[2]]


def pattern_groups(counts: dict[int, int], longest: int = MAX_LENGTH, classes: int = CLASSES) -> tuple[list[Group], dict[int, int]]:
    """Sequences by fitted patterns, and how many pieces of each length they take (the first ones). A length counts as the
    longest of its class, so a pattern's sequences have holes; its smallest document is therefore not taken from the class
    but left to ``fill_holes``, which finds the best one for each hole."""
    width = -(-longest // classes)
    queues: dict[int, list[list[int]]] = {}
    for length in sorted(counts, reverse=True):
        queues.setdefault(-(-length // width), []).append([length, 0, counts[length]])
    left = {c: sum(q[2] for q in queue) for c, queue in queues.items()}
    known = [p for p in patterns(longest // width) if all(c in left for c in p)]
    if not known:
        return [], dict.fromkeys(counts, 0)
    at = {c: i for i, c in enumerate(sorted(left))}
    a = np.zeros((len(at), len(known)))
    for j, p in enumerate(known):
        for c in p:
            a[at[c], j] += 1
    # A longer piece that finds no place costs more, so its class weighs more.
    weight = np.sqrt(np.array(sorted(left)) / classes)
    x = non_negative_least_squares(a * weight[:, None], np.array([left[c] for c in sorted(left)], float) * weight)
    groups: list[Group] = []
    for j in np.argsort(-x, kind="stable"):
        p = known[j]
        n = min(int(x[j]), *[left[c] // p.count(c) for c in p])
        if n < 1:
            break
        slots = []
        for c in p[:-1] or p:
            runs, need = [], n
            while need:
                head = queues[c][0]
                k = min(need, head[2])
                runs.append((head[0], head[1], k))
                head[1], head[2], need = head[1] + k, head[2] - k, need - k
                if not head[2]:
                    queues[c].pop(0)
            left[c] -= n
            slots.append(runs)
        if len(p) > 1:
            left[p[-1]] -= n
        cuts = sorted({0, *[int(e) for runs in slots for e in np.cumsum([r[2] for r in runs])]})
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = []
            for runs in slots:
                start = 0
                for length, first, k in runs:
                    if start <= low < start + k:
                        own.append((length, first + low - start, 1))
                    start += k
            groups.append((high - low, sum(r[0] for r in own), own))
    left_over = {length: rest for queue in queues.values() for length, _, rest in queue}
    return groups, {length: n - left_over.get(length, 0) for length, n in counts.items()}


def fill_holes(groups: list[Group], counts: dict[int, int], taken: dict[int, int], longest: int = MAX_LENGTH) -> list[Group]:
    """``groups`` and the pieces that they lack: the longest first, each into the tightest hole, or a new sequence. Pieces of a
    length are alike and so are a group's sequences, so a step places a length in a group; a group that takes pieces has
    less than half its hole left, so there are few steps for each, however many pieces there are."""
    done: list[Group] = []
    holes: list[int] = []
    open_: dict[int, list[Group]] = {}

    def put(group: Group) -> None:
        hole = longest - group[1]
        if group[0] and not hole:
            done.append(group)
        elif group[0]:
            if hole not in open_:
                insort(holes, hole)
                open_[hole] = []
            open_[hole].append(group)

    for group in groups:
        put(group)
    for length in sorted(counts, reverse=True):
        place, left = taken.get(length, 0), counts[length] - taken.get(length, 0)
        while left:
            at = bisect_left(holes, length)
            if at < len(holes):
                hole = holes[at]
                group = open_[hole].pop()
                if not open_[hole]:
                    del open_[hole]
                    holes.pop(at)
            else:
                group = (left, 0, [])
            n, used, runs = group
            m = (longest - used) // length
            full = min(n, left // m)
            rest = min(left - full * m, m - 1) if full < n else 0
            for start, k, each in ((0, full, m), (full, int(rest > 0), rest)):
                if k:
                    _, _, own = _part(group, start, k)
                    put((k, used + each * length, [*own, (length, place, each)]))
                    place, left = place + k * each, left - k * each
            if runs:
                put(_part(group, full + int(rest > 0), n - full - int(rest > 0)))
    return done + [group for hole in holes for group in open_[hole]]


def layout(counts: dict[int, int], longest: int = MAX_LENGTH) -> dict[str, np.ndarray]:
    """Where pieces go by length and place: rows (key, length, first, each, sequence, offset) in the order of keys."""
    groups, taken = pattern_groups(counts, longest)
    rows, sequence = [], 0
    for n, _, runs in fill_holes(groups, counts, taken, longest):
        offset = 0
        for length, first, m in runs:
            rows.append((_key(length, first), first, m, sequence, offset))
            offset += length * m
        sequence += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(["key", "first", "each", "sequence", "offset"], columns, strict=True))


def _key(length, place):
    """Lengths are below 2 ** 15 and places below 2 ** 48."""
    return length * (1 << 48) + place


def pack_pieces(pieces: DataFrame, longest: int = MAX_LENGTH) -> DataFrame:
    """``pieces`` (with length, from 1 to ``longest``; columns may not be named _task, _place or _key) and where they go:
    sequence_id and offset, gapless from 0, in sequences of at most ``longest``.

    Every task numbers its rows by length, and the numbers are made whole by adding what tasks before it have. The driver
    sees how many pieces there are of each length, at most ``longest`` rows; it fits the patterns and returns runs of places,
    of a size that depends on lengths alone, which tasks look their pieces up in. Pieces are not shuffled while those sums
    are small enough to be broadcast. Repeated rows are pieces like any other; no rows give none.
    """
    spark = pieces.sparkSession
    kind = StructType([*pieces.schema.fields, StructField("_task", LongType()), StructField("_place", LongType())])
    placed = stash(pieces.mapInArrow(lambda b: _numbered(b, longest), kind))
    numbers = stash(placed.groupBy("_task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(layout(counts, longest))
    earlier = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    key = F.col("_task") * (longest + 1) + F.col("length")
    bases = stash(numbers.select(key.alias("_key"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base")))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, place: pd.Series) -> pd.DataFrame:
        plan = shared.value
        at = np.searchsorted(plan["key"], _key(length.to_numpy(), place.to_numpy()), "right") - 1
        turn, among = np.divmod(place.to_numpy() - plan["first"][at], plan["each"][at])
        return pd.DataFrame({"sequence_id": plan["sequence"][at] + turn, "offset": plan["offset"][at] + among * length.to_numpy()})

    joined = join_small(placed.withColumn("_key", key), bases, "_key", BASE_BYTES * bases.count(), ["_place"])
    found = joined.withColumn("_at", where("length", F.col("_place") + F.col("_base")))
    return found.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH) -> DataFrame:
    """token_pieces of every row of ``docs`` (doc_id, text) with their places by pack_pieces. Rows with equal or null ids each
    have their pieces."""
    return pack_pieces(token_pieces(docs, tokenizer_path, longest), longest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), default_tokenizer())
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("input_ids").alias("ids_crc32")))
