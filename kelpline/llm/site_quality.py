"""Document quality by hierarchical empirical Bayes: evidence of the document, on priors of its path, host and corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, stash, table, text_of
from .words import hashes_of, in_slices, windows, words_in

#: Buckets of hashed features, and folds of labelled documents: one's evidence is learned from the other folds.
BUCKETS, FOLDS = 1 << 16, 4
#: Kinds of features: words, pairs of words, shapes of words, and counts of the document in steps.
KINDS = ("words", "pairs", "shapes", "counts")
#: Documents that a bucket has in either class before any is seen.
SMOOTHING = 1.0
#: Newton steps and ridge of the logistic regression that weighs the kinds.
NEWTON_STEPS, PENALTY = 12, 0.1
#: Limits of the strength (pseudo-count) of a prior.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Documents that are more likely bad than good go.
KEEP = 0.5

_SHAPE = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")


class _Shapes(dict):
    """The shape of a word: its runs of letters, capitals and digits, each as one, and other characters as they are."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        kind = lambda m: b"0" if m[0][:1].isdigit() else b"A" if m[0][:1].isupper() else b"a"
        value = self[word] = int(hashes_of([b"shape " + _SHAPE.sub(kind, word)[:12]])[0])
        return value


_SHAPES = _Shapes()


def _buckets(text: str) -> list[np.ndarray]:
    """The buckets of a text's features by kind, with repeats."""
    words = words_in(text)
    hashes = hashes_of([w.lower() for w in words])
    shapes = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    n, distinct = len(words), len(set(words))
    steps = [f"length {n.bit_length()}", f"distinct {int(10 * distinct / max(1, n))}", f"word {int(2 * len(text) / max(1, n))}"]
    kinds = [hashes, windows(hashes, 2), shapes, hashes_of([s.encode() for s in steps])]
    mixed = [h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 60) for k, h in enumerate(kinds)]
    return [(h >> np.uint64(48)).astype(np.int64) % BUCKETS for h in mixed]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice, rows (at, n): how many documents of a fold and class have a bucket."""
    for batch in in_slices(batches, "text"):
        found = []
        for text, fold, good in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "good")), strict=True):
            found.append(np.unique(np.concatenate(_buckets(text))) + (2 * fold + good) * BUCKETS)
        at, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["at", "n"])


def _evidence(batches: Iterable[pa.RecordBatch], odds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The mean log odds of each kind's features; a labelled document's by the odds without its fold."""
    for batch in in_slices(batches, "text"):
        rows = np.zeros((batch.num_rows, len(KINDS)))
        for at, (text, fold) in enumerate(zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
            own = odds[FOLDS if fold is None else fold]
            rows[at] = [own[b].mean() if len(b) else 0.0 for b in _buckets(text)]
        kept = [batch.column(c) for c in ("doc_id", "host", "path", "good")]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(rows[:, k]) for k in range(len(KINDS))]], ["doc_id", "host", "path", "good", *KINDS])


def _log_odds(learned: DataFrame) -> np.ndarray:
    """Log odds of good by bucket, learned without each fold and, last, from all. The driver gets 2 * FOLDS * BUCKETS
    counts at most."""
    found = learned.select("text", "fold", "good").mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * FOLDS * BUCKETS)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    sizes = np.zeros(2 * FOLDS)
    for x in learned.groupBy((2 * F.col("fold") + F.col("good")).alias("at")).count().collect():
        sizes[x["at"]] = x["count"]
    counts, sizes = counts.reshape(FOLDS, 2, BUCKETS), sizes.reshape(FOLDS, 2)
    without = [*(counts.sum(0) - counts), counts.sum(0)]
    of = [*(sizes.sum(0) - sizes), sizes.sum(0)]
    rate = lambda n, total: np.log((n + SMOOTHING) / (total + 2 * SMOOTHING))
    return np.array([rate(n[1], t[1]) - rate(n[0], t[0]) for n, t in zip(without, of, strict=True)], np.float32)


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _weighed(rows: DataFrame) -> np.ndarray:
    """Weights of 1 and the KINDS in a logistic regression of good on them with logit(path_rate) as offset, by Newton steps
    whose sums Spark makes."""
    inputs = [F.lit(1.0), *[F.col(k) for k in KINDS]]
    n, weights = len(inputs), np.zeros(len(inputs))
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + F.exp(-(F.col("offset") + sum(float(w) * x for w, x in zip(weights, inputs, strict=True)))))
        sums = rows.withColumn("p", p).agg(
            *[F.sum((F.col("good") - F.col("p")) * x).alias(f"g{i}") for i, x in enumerate(inputs)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * x * inputs[j]).alias(f"h{i}_{j}") for i, x in enumerate(inputs) for j in range(i + 1)],
        ).first()
        gradient = np.array([sums[f"g{i}"] for i in range(n)]) - PENALTY * weights
        curve = np.array([[sums[f"h{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) + PENALTY * np.eye(n)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        weights = weights + step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score, kept of every row of ``docs`` (doc_id, text and the
    columns ``host`` and ``path``), learned from ``labels`` (doc_id, quality: 1 good, 0 bad).

    Evidence is what a naive Bayes classifier finds in the whole text: mean log odds of its words, pairs and shapes of
    words and counts, counted over all labelled documents and weighed by a logistic regression. A host's rate of good
    documents is shrunk to that of all, and the rate of a path within the host to the host's; how much follows from how
    hosts (and paths) differ, so a site without labels has the rate above it. A labelled document counts neither for its
    own evidence (it is learned without its fold, in which all documents with its words are) nor for its own site's rates.
    score = logistic(evidence + logit(path_rate)), and documents below KEEP go.

    A null text is empty. Null hosts and paths are sites of no name; a document with several labels is good if the most
    of them are, then if one is; labels without a document or a value teach nothing, and without labels every score is
    0.5. Rows with one id each have a row; no rows give no rows. Columns other than those named are ignored. Texts are
    shuffled only to meet more labels than may be broadcast; the driver gets counts by bucket.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("good")
    )
    known = stash(known)
    known = F.broadcast(known) if 24 * known.count() <= MOST_BROADCAST else known
    slim = docs.select("doc_id", text_of().alias("text"), _group(host).alias("host"), _group(path).alias("path"))
    # Copies are in one fold, so that a label doesn't come back through another row with its words.
    same = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")))
    fold = F.when(F.col("good").isNotNull(), F.pmod(same, F.lit(FOLDS)).cast("int"))
    rows = slim.join(known, "doc_id", "left").withColumn("fold", fold)
    learned = rows.filter("good IS NOT NULL")
    total = learned.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    n_good, n_bad = total["good"], total["n"] - total["good"]
    prior = (n_good + 1) / (total["n"] + 2)
    can_learn = n_good and n_bad
    odds = docs.sparkSession.sparkContext.broadcast(_log_odds(learned) if can_learn else np.zeros((FOLDS + 1, BUCKETS), np.float32))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, host string, path string, good int, " + ", ".join(f"{k} double" for k in KINDS)
    rows = stash(rows.mapInArrow(lambda b: _evidence(b, odds.value), schema))
    learned = rows.filter("good IS NOT NULL")

    by_host = stash(learned.groupBy("host").agg(F.count("*").alias("host_n"), F.sum("good").alias("host_good")))
    by_path = stash(learned.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("good").alias("path_good")))
    host_m = between(by_host.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(prior).alias("prior")))
    own = (F.col("host_good") + host_m * prior) / (F.col("host_n") + host_m)
    path_m = between(by_path.join(by_host, "host").select(F.col("path_n").alias("n"), F.col("path_good").alias("good"), own.alias("prior")))

    sites = rows.join(by_host, "host", "left").join(by_path, ["host", "path"], "left")
    less_n, less_good = F.when(F.col("good").isNotNull(), 1).otherwise(0), F.coalesce("good", F.lit(0))

    def rate(level: str, m: float, above: Column) -> Column:
        n, good = (F.coalesce(f"{level}_{c}", F.lit(0)) for c in ("n", "good"))
        return (good - less_good + m * above) / (n - less_n + m)

    rated = sites.withColumn("host_rate", rate("host", host_m, F.lit(prior)))
    rated = rated.withColumn("path_rate", rate("path", path_m, F.col("host_rate")))
    rated = stash(rated.withColumn("offset", F.log(F.col("path_rate") / (1 - F.col("path_rate")))).drop("host_n", "host_good", "path_n", "path_good"))
    weights = _weighed(rated.filter("good IS NOT NULL")) if can_learn else np.zeros(len(KINDS) + 1)
    evidence = sum((float(w) * F.col(k) for w, k in zip(weights[1:], KINDS, strict=True)), F.lit(float(weights[0])))
    rated = rated.withColumn("evidence", evidence).withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.col("offset")))))
    return rated.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("kept"))


def between(rates: DataFrame) -> float:
    """The pseudo-count of a beta prior by moments, from groups with n, good and the prior they are shrunk to: with
    rho = 1 / (m + 1), a group's rate varies around its prior by prior * (1 - prior) * (1 / n + rho * (1 - 1 / n))."""
    squared = (F.col("good") / F.col("n") - F.col("prior")) ** 2
    chance = F.col("prior") * (1 - F.col("prior"))
    x = rates.agg(
        F.sum(F.col("n") * squared - chance).alias("more"), F.sum(chance * (F.col("n") - 1)).alias("each")
    ).first()
    if not x["each"] or x["more"] <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, x["each"] / x["more"] - 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
