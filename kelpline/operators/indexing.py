"""Character n-grams, TF-IDF vectors and full-text postings (I1 to I5); ``index_store`` writes them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.text import tokens
from kelpline.operators.cleaning import active_units
from kelpline.operators.storage import stash

MAX_FEATURES = 1024
#: Cells of a matrix that a Python worker counts in, about, and words whose grams it looks up at a time.
CELLS, SOME_WORDS = 1 << 17, 4_096
#: Bytes of text whose words are looked up at a time, about, and words of a row of counts.
PART, WORDS_ROW = 1 << 24, 256


def _words() -> Column:
    return F.array_remove(F.split(_lower("text"), r"\s+"), "")


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def word_parts(batches: Iterator[pa.RecordBatch], names: Sequence[str] = ("text",)) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, int]]:
    """Slices of the batches, of some PART bytes of the columns ``names`` (lower-cased, without nulls), with the row and the code
    of each of their words, column after column, the words by code, and how many the last column has. Words are what six ASCII
    characters of white space part, as for ``_words``."""
    for batch in batches:
        ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART, "right")))
            part = batch.slice(start, stop - start)
            split = [pc.ascii_split_whitespace(part.column(c)) for c in names]
            row = np.concatenate([np.repeat(np.arange(part.num_rows), s.value_lengths().to_numpy()) for s in split])
            of_last = len(row) - sum(len(s.flatten()) for s in split[:-1])
            encoded = pa.concat_arrays([s.flatten() for s in split]).dictionary_encode()
            code, words = encoded.indices.to_numpy(), encoded.dictionary
            empty = pc.index(words, "").as_py()  # at the ends of a text
            if empty >= 0:
                of_last = np.count_nonzero(code[len(code) - of_last :] != empty)
                row, code = row[code != empty], code[code != empty]
            yield part, row, code, words, of_last
            start = stop


def _grams_of(low: int, high: int) -> Column:
    """The n-grams of the word ``w``, padded by a space: a padded word of length L has L - n + 1 grams of n <= L."""
    padded = F.concat(F.lit(" "), "w", F.lit(" "))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.expr("cast(array() AS array<string>)"))

    return F.flatten(F.array(*[of_size(n) for n in range(low, high + 1)]))


def char_wb_ngrams(units: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """id, gram, tf: all n-grams within the words of each unit (id, text)."""
    words = units.select("id", F.explode(_words()).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    return words.select("id", "n", F.explode(_grams_of(low, high)).alias("gram")).groupBy("id", "gram").agg(F.sum("n").alias("tf"))


def _padded(words: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The words, each between two spaces, as one text; its characters as numbers, each one's word, and how many characters of
    its padded word there are from it on."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "  ")
    text = f" {joined[0].as_py()} "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    return text, points, np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))


def _lookup(names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For grams ``names``, a list of bounded size: a number for each character of theirs (0 for all others), the table of what
    follows from a beginning of a gram (1: the empty one, 0: none) by the next character, the place of the gram that a
    beginning is (or -1), and the longest size."""
    number = np.zeros(0x110000, np.int32)
    letters = sorted(set("".join(names)))
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    known = {"": 1} | {g: i for i, g in enumerate(sorted({g[:j] for g in names for j in range(1, len(g) + 1)}), 2)}
    follows, place = np.zeros((len(known) + 1, len(letters) + 1), np.int32), np.full(len(known) + 1, -1, np.int32)
    for start, i in known.items():
        if start:
            follows[known[start[:-1]], number[ord(start[-1])]] = i
    for i, g in enumerate(names):
        place[known[g]] = i
    return number, follows, place, max(map(len, names), default=0)


def _places(words: pa.Array, lookup: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the grams of all ``words``, word after word, and how many each word has."""
    number, follows, place, longest = lookup
    width, table = follows.shape[1], follows.ravel()
    found, n_of = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for start in range(0, len(words), SOME_WORDS):
        some = words.slice(start, SOME_WORDS)
        _, points, word, left = _padded(some)
        letters = np.concatenate([number[points], np.zeros(longest, np.int32)])
        state, owners, places = np.ones(len(points), np.int32), [], []
        for j in range(longest):
            state = table[state * width + letters[j : j + len(points)]] * (left > j)
            at = place[state]
            hit = np.flatnonzero(at >= 0)
            owners.append(word[hit])
            places.append(at[hit])
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        found.append(np.concatenate([*places, np.zeros(0, np.int32)])[np.argsort(owner, kind="stable")])
        n_of.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(found), np.concatenate(n_of)


def _gram_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, total over each batch of words (w, n), for grams of 2 to 4 characters. A gram is a number by its characters, or
    by its two halves; it becomes a string once in a batch."""
    for batch in batches:
        words = batch.column("w")
        if not len(words):
            continue
        text, points, word, left = _padded(words)
        n = batch.column("n").to_numpy()[word]
        pairs = points[:-1] << 21 | points[1:]
        halves = np.unique(pairs, return_inverse=True)[1]
        keys = {2: pairs, 3: pairs[:-1] << 21 | points[2:], 4: halves[:-2] << 32 | halves[2:]}
        grams, totals = [], []
        for size, key in keys.items():
            inside = np.flatnonzero(left[: len(key)] >= size)
            order = np.argsort(key[inside], kind="stable")
            ordered = key[inside][order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            grams += [text[i : i + size] for i in inside[order[first]].tolist()]
            totals.append(np.add.reduceat(n[inside][order], first) if len(first) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.concatenate(totals), pa.int64())], ["gram", "total"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, n: the words of slices of the batches (text), and how often they are there."""
    for _, _, code, words, _ in word_parts(batches):
        n = np.bincount(code, minlength=len(words))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(there)), pa.array(n[there], pa.int64())], ["w", "n"])


def top_grams(units: DataFrame, max_features: int = MAX_FEATURES, words: DataFrame | None = None) -> dict[str, int]:
    """The ``max_features`` grams that are most frequent in ``units`` (id, text), ties by gram, with how often they are there.
    Words are counted over all units before they are cut into grams, so that a gram is made once for each distinct word; or
    they are given, as counts (w, n) of which a word may have several."""
    if words is None:
        words = units.select(_lower("text").alias("text")).mapInArrow(_word_counts, "w string, n long")
    counted = words.groupBy("w").agg(F.sum("n").alias("n"))
    totals = counted.mapInArrow(_gram_totals, "gram string, total long").groupBy("gram").agg(F.sum("total").alias("total"))
    return {r["gram"]: r["total"] for r in totals.orderBy(F.desc("total"), "gram").limit(max_features).collect()}  # at most max_features


def _holders(batches: Iterator[pa.RecordBatch], n_grams: int) -> Iterator[pa.RecordBatch]:
    """at, df: how many rows of a task have each gram; the rows themselves are counted as -1."""
    df, n = np.zeros(n_grams, np.int64), 0
    for batch in batches:
        df += np.bincount(batch.column("at").flatten().to_numpy(), minlength=n_grams)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_grams), pa.int32()), pa.array(np.concatenate([[n], df]))], ["at", "df"])


def gram_index(units: DataFrame, max_features: int = MAX_FEATURES, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``units`` (id, text): the vocabulary, as ``gram_vocabulary``, and the vectors, as ``gram_vectors``. Texts are
    read twice: for the words, if their counts aren't given (``top_grams``), and for the counts of the grams that stay, of which
    both tables are made."""
    spark, totals = units.sparkSession, top_grams(units, max_features, words)
    names = sorted(totals)
    counts = stash(gram_counts(units, names, every=True))
    held = counts.select("at").mapInArrow(lambda b: _holders(b, len(names)), "at int, df long").groupBy("at").agg(F.sum("df").alias("df"))
    df = {r["at"]: r["df"] for r in held.collect()}
    idf = [math.log((1.0 + df.get(-1, 0)) / (1.0 + df[i])) + 1.0 for i in range(len(names))]
    place = {g: i for i, g in enumerate(names)}
    rows = [(g, total, df[place[g]], idf[place[g]]) for g, total in totals.items()]
    vocabulary = spark.createDataFrame(rows, "gram string, total long, df long, idf double")
    vectors = counts.filter(F.size("at") > 0).mapInArrow(lambda b: _weighed(b, np.array(idf)), f"id {units.schema['id'].dataType.simpleString()}, at array<int>, weight array<double>")
    return vocabulary, vectors


def gram_vocabulary(units: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """gram, total, df, idf of the ``max_features`` grams that are most frequent in ``units`` (id, text), ties by gram."""
    return gram_index(units, max_features)[0]


def _weighed(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of id, at, tf that have a gram, with weights at unit length for counts."""
    for batch in batches:
        at, tf = batch.column("at"), batch.column("tf")
        places, ends = at.flatten().to_numpy(), np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
        weights = tf.flatten().to_numpy() * idf[places]
        norm = np.sqrt(np.add.reduceat(weights * weights, ends[:-1])) if len(places) else np.zeros(0)
        weights = weights / np.repeat(norm, np.diff(ends)) if len(places) else weights
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weights, pa.float64()))], ["id", "at", "weight"])


def _gram_rows(batches: Iterator[pa.RecordBatch], names: Sequence[str], every: bool) -> Iterator[pa.RecordBatch]:
    """For each unit with any of the grams, or ``every`` unit: id, their places and counts. A batch's distinct words are looked
    up at once; its rows are summed up some CELLS cells of a matrix of rows and places at a time."""
    lookup, n_names = _lookup(names), max(1, len(names))
    for batch, row_of, codes, words, _ in word_parts(batches):
        flat, n_of = _places(words, lookup)
        begin = np.cumsum(n_of) - n_of
        ends = np.cumsum(np.bincount(row_of, minlength=batch.num_rows))
        rows, n, at, tf = max(1, CELLS // n_names), [], [], []
        for start in range(0, batch.num_rows, rows):
            stop = min(batch.num_rows, start + rows)
            counts = np.zeros((stop - start, n_names), np.int64)
            low_word, high_word = ends[start - 1] if start else 0, ends[stop - 1]
            for some in range(low_word, high_word, CELLS // 8):
                code = codes[some : min(high_word, some + CELLS // 8)]
                size = n_of[code]
                ahead = np.cumsum(size) - size
                place = flat[np.repeat(begin[code] - ahead, size) + np.arange(size.sum())]
                row = np.repeat(row_of[some : some + len(code)] - start, size)
                counts += np.bincount(row * n_names + place, minlength=counts.size).reshape(counts.shape)
            r, c = np.nonzero(counts)
            n.append(np.bincount(r, minlength=stop - start))
            at.append(c)
            tf.append(counts[r, c])
        n = np.concatenate([*n, np.zeros(0, np.int64)])
        kept = np.arange(batch.num_rows) if every else np.flatnonzero(n)
        to = pa.array(np.concatenate([[0], np.cumsum(n[kept])]), pa.int32())
        lists = [pa.ListArray.from_arrays(to, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), t)) for x, t in ((at, pa.int32()), (tf, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int64())), *lists], ["id", "at", "tf"])


def gram_counts(units: DataFrame, names: Sequence[str], every: bool = False) -> DataFrame:
    """id, at, tf: how often each unit (id, text) has each of the grams ``names``, a list of bounded size, by their places;
    of units that have any, or of ``every`` one. Nothing is shuffled."""
    names = list(names)
    rows = units.select("id", _lower("text").alias("text"))
    return rows.mapInArrow(lambda b: _gram_rows(b, names, every), f"id {units.schema['id'].dataType.simpleString()}, at array<int>, tf array<bigint>")


def gram_vectors(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, at, weight: tf * idf at unit length as two arrays, at being places in the vocabulary (gram, idf) in the order of
    grams; of units that have any gram. Nothing is shuffled."""
    rows = sorted((r["gram"], r["idf"]) for r in vocabulary.select("gram", "idf").collect())  # at most max_features
    idf = np.array([x for _, x in rows])
    counts = gram_counts(units, [g for g, _ in rows])
    return counts.mapInArrow(lambda b: _weighed(b, idf), f"id {units.schema['id'].dataType.simpleString()}, at array<int>, weight array<double>")


def build_index(units: DataFrame, max_features: int = MAX_FEATURES) -> dict[str, DataFrame]:
    """The tables of an index over the active ones of ``units``: vocabulary, vectors, postings and stats."""
    active = active_units(units)
    vocabulary, vectors = gram_index(active, max_features)
    return {"vocabulary": vocabulary, "vectors": vectors, "postings": text_postings(active), "stats": text_stats(active)}


def bucket_of(token: Column, buckets: int) -> Column:
    """Readers of some tokens filter postings by their buckets, which prunes the files that are read."""
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def in_buckets(postings: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """The rows of written ``postings`` that may be of the tokens ``asked`` (token). The buckets that these fall in, of which
    there are a fixed number, become a filter of the partition column, so the folders of all others aren't read."""
    wanted = sorted(r["bucket"] for r in asked.select(bucket_of(F.col("token"), buckets).alias("bucket")).distinct().collect())
    return postings.filter(F.col("bucket").isin(wanted)) if len(wanted) < buckets else postings


def index_sizes(index: dict[str, DataFrame]) -> DataFrame:
    """part, n_rows of each table of an index, and the number of distinct tokens."""
    out = [index[name].agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("part"), "n_rows") for name in ("vocabulary", "vectors", "postings")]
    out.append(document_frequencies(index["postings"]).agg(F.count("*").alias("n_rows")).select(F.lit("tokens").alias("part"), "n_rows"))
    out.append(index["stats"].select(F.lit("units").alias("part"), F.col("n_units").alias("n_rows")))
    return reduce(DataFrame.unionByName, out)


def normalize_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of doubles at unit length; a zero vector stays."""
    own = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(column, F.transform(own, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))


def unit_tokens(units: DataFrame) -> DataFrame:
    """id, t: the tokens of title, text and summary."""
    fields = [c for c in ("title", "text", "summary") if c in units.columns]
    return units.select("id", F.concat(*[tokens(F.col(c)) for c in fields]).alias("t"))


def count_tokens(rows: DataFrame) -> DataFrame:
    """id, token, tf, len of unit_tokens."""
    each = rows.select("id", F.size("t").cast("long").alias("len"), F.explode("t").alias("token"))
    return each.groupBy("id", "token", "len").agg(F.count("*").alias("tf"))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, token, len, tf of rows of tokens (id, t), some CELLS tokens at a time."""
    for batch in batches:
        ends = np.cumsum(batch.column("t").value_lengths().to_numpy())
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
            part = batch.slice(start, stop - start)
            lengths = part.column("t").value_lengths().to_numpy().astype(np.int64)
            encoded = part.column("t").flatten().dictionary_encode()
            n = max(1, len(encoded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(part.num_rows), lengths) * n + encoded.indices.to_numpy(), return_counts=True)
            row = key // n
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), encoded.dictionary.take(pa.array(key % n)), pa.array(lengths[row]), pa.array(tf.astype(np.int64))], ["id", "token", "len", "tf"])
            start = stop


def count_own_tokens(rows: DataFrame) -> DataFrame:
    """As count_tokens, of rows that have each id once: nothing is shuffled."""
    return rows.select("id", "t").mapInArrow(_token_rows, f"id {rows.schema['id'].dataType.simpleString()}, token string, len long, tf long")


def _token_pattern(spark: SparkSession) -> str:
    """A pattern of Python's for the runs of letters and digits that ``text.tokens`` takes, from the ranges of characters that
    the engine's own pattern has: those of Python's may be another Unicode version's. A few hundred ranges."""
    points = spark.range(0x110000).filter("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    taken = points.filter(char.rlike(r"[\p{L}\p{N}]")).select("id", F.row_number().over(W.partitionBy(F.floor(F.col("id") / 65536)).orderBy("id")).alias("n"))
    runs = taken.groupBy(F.floor(F.col("id") / 65536).alias("plane"), (F.col("id") - F.col("n")).alias("run")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return "[" + "".join(f"\\U{r['low']:08x}-\\U{r['high']:08x}" for r in runs.collect()) + "]+"


def _lists(batches: Iterator[pa.RecordBatch], fields: Sequence[str], pattern: str, asked: pa.Array | None, counted: bool) -> Iterator[pa.RecordBatch]:
    """For slices of the batches, a row for each token, of those ``asked`` if given: token and units (id, len, tf); one with own
    (id, len) of all rows; and, if ``counted``, rows with some words (w, n) of ``text``, the last field."""
    find = re.compile(pattern).findall
    for part, row, code, words, of_last in word_parts(batches, fields):
        n_rows, plain = part.num_rows, pc.match_substring_regex(words, "^[a-z0-9]+$").to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~plain)
        of_odd = [find(w) for w in words.take(pa.array(odd)).to_pylist()]
        n_of = plain.astype(np.int64)
        n_of[odd] = [len(t) for t in of_odd]
        known = pa.concat_arrays([words.filter(pa.array(plain)), pa.array([t for ts in of_odd for t in ts], pa.string())]).dictionary_encode()
        flat, begin = known.indices.to_numpy().astype(np.int64), np.cumsum(plain) - 1
        begin[odd] = plain.sum() + np.cumsum(n_of[odd]) - n_of[odd]
        size = n_of[code]
        token = flat[np.repeat(begin[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        of_token = np.repeat(row, size)
        lengths = np.bincount(of_token, minlength=n_rows)
        if asked is not None:
            kept = pc.is_in(known.dictionary, asked).to_numpy(zero_copy_only=False)[token]
            token, of_token = token[kept], of_token[kept]
        key, tf = np.unique(token * n_rows + of_token, return_counts=True)
        token, of_token = key // n_rows, key % n_rows
        first, ids = np.flatnonzero(np.diff(token, prepend=-1)), part.column("id")
        listed = pa.StructArray.from_arrays([ids.take(pa.array(of_token)), pa.array(lengths[of_token]), pa.array(tf)], ["id", "len", "tf"])
        own = pa.StructArray.from_arrays([ids, pa.array(lengths)], ["id", "len"])
        n = np.bincount(code[len(code) - of_last :], minlength=len(words)) if counted else np.zeros(0, np.int64)
        there = np.flatnonzero(n)
        some = pa.StructArray.from_arrays([words.take(pa.array(there)), pa.array(n[there], pa.int64())], ["w", "n"])
        n_tokens, cuts = len(first), [*range(0, len(there), WORDS_ROW), len(there)]
        more = len(cuts) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([known.dictionary.take(pa.array(token[first])), pa.nulls(1 + more, pa.string())]),
                pa.ListArray.from_arrays(pa.array([*first, *[len(key)] * (2 + more)], pa.int32()), listed),
                pa.ListArray.from_arrays(pa.array(np.repeat([0, n_rows], [n_tokens + 1, 1 + more]), pa.int32()), own),
                pa.ListArray.from_arrays(pa.array([*[0] * (n_tokens + 1), *cuts], pa.int32()), some),
            ],
            ["token", "units", "own", "words"],
        )


def posting_lists(units: DataFrame, asked: Sequence[str] | None = None, counted: bool = False) -> DataFrame:
    """token, units: the postings of units that have each id once, as lists (id, len, tf) by token, several of a token, of the
    tokens ``asked`` or of all; in rows without a token own, id and len of every unit, and, if ``counted``, words of the texts and
    how often they are there (w, n), for ``top_grams``. Texts are read once, and nothing is shuffled."""
    spark, fields = units.sparkSession, [c for c in ("title", "summary", "text") if c in units.columns]
    pattern, kind = _token_pattern(spark), units.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(None if asked is None else pa.array(asked, pa.string()))
    schema = f"token string, units array<struct<id: {kind}, len: bigint, tf: bigint>>, own array<struct<id: {kind}, len: bigint>>, words array<struct<w: string, n: bigint>>"
    return units.select("id", *[_lower(c).alias(c) for c in fields]).mapInArrow(lambda b: _lists(b, fields, pattern, sent.value, counted), schema)


def asked_index(units: DataFrame, texts: DataFrame, max_features: int = MAX_FEATURES, most_tokens: int = 1 << 20) -> dict[str, DataFrame]:
    """The tables of an index over the active ones of ``units`` as far as recall for ``texts`` (text) needs them: all of
    vocabulary, vectors and stats, and the postings of the texts' tokens (of all tokens, where these are more than
    ``most_tokens``). Units' texts are read twice and nothing of them is shuffled but the counts of words."""
    active = active_units(units)
    if has_copies(active):
        return build_index(units, max_features)
    tokens_of = stash(texts.select(F.explode(tokens(F.col("text"))).alias("token")).distinct())
    asked = [r["token"] for r in tokens_of.collect()] if tokens_of.count() <= most_tokens else None
    made = stash(posting_lists(active, asked, counted=True))
    vocabulary, vectors = gram_index(active, max_features, made.select(F.inline("words")))
    stats = made.select(F.inline("own")).agg(F.count("*").alias("n_units"), F.avg("len").alias("avg_len"))
    postings = made.filter("token IS NOT NULL").select("token", F.inline("units"))
    return {"vocabulary": vocabulary, "vectors": vectors, "postings": postings, "stats": stats}


def has_copies(units: DataFrame) -> bool:
    """Whether an id is there twice."""
    return bool(units.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())


def text_postings(units: DataFrame) -> DataFrame:
    """id, token, tf, len: tokens over title, text and summary. tf and len are whole numbers."""
    return count_tokens(unit_tokens(units))


def text_stats(units: DataFrame) -> DataFrame:
    """One row: n_units and avg_len, units without tokens included."""
    fields = [c for c in ("title", "text", "summary") if c in units.columns]
    n = sum((F.size(tokens(F.col(c))) for c in fields), F.lit(0))
    return units.agg(F.count("*").alias("n_units"), F.avg(n).alias("avg_len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("df"))
