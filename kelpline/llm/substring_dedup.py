"""Repeated passages: words covered by a window that an earlier document has as well are removed.

Suffix automata of reference shards, broadcast to stream all documents past them, can't do this whole job: each document
is both reference and query, so every shard would meet every document and the work would grow with the square of the
corpus. Windows are matched by grouping instead: only windows around word runs that several documents share are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitsets import gather_bits
from .common import stash, table, text_of
from .words import Bits, hashes_of, in_slices, sequence_key, windows, words_in

#: Words of a window, and of the runs of which a window's anchor is the one with the least hash.
WINDOW, ANCHOR = 13, 5
#: The first multiplier of a window's second hash.
OTHER = 24


def anchors(hashes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each window the least hash of its runs of ANCHOR words: equal windows have equal anchors, and neighbouring
    windows mostly share theirs."""
    runs = windows(hashes, ANCHOR)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least, width = runs, 1
    while width < size - ANCHOR + 1:  # the least of twice as many runs, or of as many more as are wanted
        step = min(width, size - ANCHOR + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def covered(starts: np.ndarray, n_words: int, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _tag(key: bytes) -> int:
    return int.from_bytes(key[:4], "little")


def _batch(columns: list[tuple[str, list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in columns], [n for n, _, _ in columns])


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key (of the word sequence), its tag and n_words of each row."""
    for batch in in_slices(batches, "text"):
        hashes = [hashes_of(words_in(t)) for t in batch.column("text").to_pylist()]
        keys = [sequence_key(h) for h in hashes]
        tags = [_tag(k) for k in keys]
        yield _batch([("doc_id", batch.column("doc_id"), pa.int64()), ("key", keys, pa.binary()), ("tag", tags, pa.int64()), ("n_words", [len(h) for h in hashes], pa.int64())])


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchors of each row, once for each word sequence in a task."""
    seen: set[bytes] = set()
    for batch in in_slices(batches, "text"):
        found, ids = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = hashes_of(words_in(text))
            if len(hashes) < WINDOW or (key := sequence_key(hashes)) in seen:
                continue
            seen.add(key)
            found.append(np.unique(anchors(hashes)))
            ids.append(np.full(len(found[-1]), doc_id, np.int64))
        if found:
            yield _batch([("anchor", np.concatenate(found).view(np.int64), pa.int64()), ("doc_id", np.concatenate(ids), pa.int64())])


def _window_rows(batches: Iterable[pa.RecordBatch], shared: Bits) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor may be shared: window and check (128 bits of hashes), doc_id and place (start * 2 ** 32 + a
    tag of the row). A row with
    the words of one that had no larger id is left out: it is a copy, or the same document again."""
    seen: dict[bytes, int] = {}
    for batch in in_slices(batches, "text"):
        out: list[tuple[np.ndarray, ...]] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = hashes_of(words_in(text))
            if len(hashes) < WINDOW or seen.get(key := sequence_key(hashes), doc_id + 1) <= doc_id:
                continue
            seen[key] = doc_id
            at = np.flatnonzero(shared.has(anchors(hashes)))
            if len(at):
                other = windows(hashes, WINDOW, OTHER)[at].view(np.int64)
                out.append((windows(hashes, WINDOW)[at].view(np.int64), other, np.full(len(at), doc_id, np.int64), (at.astype(np.int64) << 32) | _tag(key)))
        if out:
            w, c, d, p = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _batch([("window", w, pa.int64()), ("check", c, pa.int64()), ("doc_id", d, pa.int64()), ("place", p, pa.int64())])


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
#: The start that stands for a whole document.
WHOLE = -1


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (doc_id, text) that lose nothing, or (doc_id, text, places) that lose the windows at the places
    with their tag."""
    for batch in in_slices(batches, "text"):
        n, removed, kept = [], [], []
        places = batch.column("places") if "places" in batch.schema.names else None
        for at, text in enumerate(batch.column("text").to_pylist()):
            words = words_in(text)
            n.append(len(words))
            removed.append(0)
            if places is not None and places[at].is_valid:
                own = places[at].values.to_numpy(zero_copy_only=False)
                starts = own[(own & 0xFFFFFFFF) == _tag(sequence_key(hashes_of(words)))] >> 32
                if len(starts):
                    gone = np.ones(len(words), bool) if starts.min() == WHOLE else covered(starts, len(words))
                    removed[-1] = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_RESULT)


def _flagged(batches: Iterable[pa.RecordBatch], hit: Bits, wanted: bool) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        mask = hit.has(batch.column("mark").to_numpy().view(np.uint64))
        yield batch.select(["doc_id", "text"]).filter(pa.array(mask if wanted else ~mask))


def _ids(batches: Iterable[pa.RecordBatch], among: Bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["doc_id"]).filter(pa.array(among.has(batch.column("mark").to_numpy().view(np.uint64))))


def _firsts(batches: Iterable[pa.RecordBatch], gone: Bits, back: Bits) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        marks = batch.column("mark").to_numpy().view(np.uint64)
        yield batch.filter(pa.array(~gone.has(marks) | back.has(marks)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than space and U+0009 to U+000D. A word is removed when a window of WINDOW words
    over it also begins in a document with a smaller id; windows are judged on the input. Kept words are joined by a
    space. A row with a null id has no smaller and is no smaller one: it loses nothing and takes nothing. Rows with one
    id take nothing from each other. A null text has no words; no rows give no rows.

    A document with the words of one with a smaller id is emptied by that (if it has WINDOW words). For the others,
    anchors (about one in five words) are grouped; a second reading takes the windows whose anchor several documents
    have, finds each window's smallest id by a grouped minimum, and joins it to the windows. Only documents that lose
    words have their texts shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    profile = stash(named.mapInArrow(_profile, "doc_id long, key binary, tag long, n_words long"))
    first = profile.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    copies = profile.join(first, "key").filter(f"doc_id > first_id AND n_words >= {WINDOW}")
    emptied = stash(copies.select("doc_id", (F.lit(WHOLE << 32) + F.col("tag")).alias("place")).distinct())

    # Copies are left out by a filter of bounded size. What it would leave out beyond copies is known from the profile and
    # taken in again.
    gone = gather_bits(emptied.select(F.xxhash64("doc_id").alias("mark")))
    wrongly = profile.select("doc_id", F.xxhash64("doc_id").alias("mark")).mapInArrow(lambda b: _ids(b, gone.value), "doc_id long")
    wrongly = wrongly.join(emptied, "doc_id", "left_anti")
    back = gather_bits(wrongly.select(F.xxhash64("doc_id").alias("mark")))
    first_rows = named.withColumn("mark", F.xxhash64("doc_id"))
    firsts = lambda b: _firsts(b, gone.value, back.value)

    several = first_rows.mapInArrow(lambda b: _anchor_rows(firsts(b)), "anchor long, doc_id long").groupBy("anchor")
    several = several.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = gather_bits(several)
    found = stash(first_rows.mapInArrow(lambda b: _window_rows(firsts(b), shared.value), "window long, check long, doc_id long, place long"))
    owners = found.groupBy("window", "check").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("b")).filter("owner < b")
    # Owners are written, so that both sides of the join are plain shuffles and a hot window's rows can be split.
    later = found.join(stash(owners.drop("b")), ["window", "check"]).filter("owner < doc_id").select("doc_id", "place")
    lost = stash(later.unionByName(emptied).groupBy("doc_id").agg(F.collect_list("place").alias("places")))

    hit = gather_bits(lost.select(F.xxhash64("doc_id").alias("mark")))
    marked = rows.withColumn("mark", F.xxhash64("doc_id"))
    whole = marked.mapInArrow(lambda b: _flagged(b, hit.value, False), "doc_id long, text string").mapInArrow(_kept, RESULT)
    flagged = marked.mapInArrow(lambda b: _flagged(b, hit.value, True), "doc_id long, text string")
    return whole.unionByName(flagged.join(lost, "doc_id", "left").mapInArrow(_kept, RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
