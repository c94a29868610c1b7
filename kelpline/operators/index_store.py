"""A written index of generations: rebuilt, extended batch by batch, and opened for recall."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import indexing
from kelpline.operators.cleaning import active_units
from kelpline.operators.storage import read_if_there, stash

BUCKETS = 64
#: A generation's row: ``batch`` names what it was made from. Counts are of its units and of older ones that it replaces.
MANIFEST = "seq long, kind string, batch string, folder string, buckets int, n_units long, total_len long, n_replaced long, replaced_len long"


@dataclass
class WrittenIndex:
    """The tables of an index in files: vocabulary, vectors, postings (with their bucket) and stats, by name."""

    tables: dict[str, DataFrame]
    generations: int

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _live(spark: SparkSession, path: str) -> list[Row]:
    """The committed generations from the last rebuild on, in order. A table of one row for each."""
    rows = read_if_there(spark, f"{path}/manifest", MANIFEST)
    every = sorted(rows.collect(), key=lambda r: r["seq"]) if rows is not None else []
    start = max((i for i, r in enumerate(every) if r["kind"] == "rebuild"), default=0)
    return every[start:]


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    """From here on a generation is part of the index. A number is written once: of two writers one fails."""
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/seq-{row[0]:09d}")


def _write(active: DataFrame, vocabulary: DataFrame, folder: str, buckets: int, vectors: DataFrame | None = None) -> tuple[int, int]:
    """Write vectors (those given, or by the vocabulary), postings and units (id, len) of the units; their number and their
    tokens. Texts are tokenized once."""
    spark = active.sparkSession
    (indexing.gram_vectors(active, vocabulary) if vectors is None else vectors).write.parquet(f"{folder}/vectors")
    bucket = indexing.bucket_of(F.col("token"), buckets).alias("bucket")
    if indexing.has_copies(active):
        tokens = stash(indexing.unit_tokens(active))
        lengths = tokens.select("id", F.size("t").cast("long").alias("len"))
        lists = indexing.count_tokens(tokens).select("token", F.array(F.struct("id", "len", "tf")).alias("units"))
    else:
        made = stash(indexing.posting_lists(active))
        lengths, lists = made.select(F.inline("own")), made.filter("token IS NOT NULL").select("token", "units")
    lengths.write.parquet(f"{folder}/units")
    # A bucket with a frequent token is written by several tasks, which order their rows by bucket.
    lists.select("*", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/postings")
    sums = spark.read.parquet(f"{folder}/units").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    return sums["n"], sums["total"]


def rebuild_index(units: DataFrame, path: str, buckets: int = BUCKETS, max_features: int = indexing.MAX_FEATURES) -> WrittenIndex:
    """Write an index of the active ones of ``units`` (id, text, source_status; title and summary if there) below ``path``, and
    open it. What was there stays in use until the new one is committed, and its files stay."""
    spark = units.sparkSession
    active = active_units(units)
    folder = f"{path}/generation-{uuid.uuid4().hex}"
    vocabulary, vectors = indexing.gram_index(active, max_features)
    vocabulary.write.parquet(f"{folder}/vocabulary")
    n, total = _write(active, vocabulary, folder, buckets, vectors)
    seq = max((r["seq"] for r in _live(spark, path)), default=-1) + 1
    _commit(spark, path, (seq, "rebuild", None, folder, buckets, n, total, 0, 0))
    return open_index(spark, path)


def add_to_index(units: DataFrame, path: str, batch: str) -> WrittenIndex:
    """Add ``units`` to the index at ``path`` as the generation ``batch``, with the vocabulary that the index has. Active units
    are added; of units that are there already the new row holds, and one that isn't active any more goes. A batch that
    was committed adds nothing; one that broke off before has left files that nothing reads."""
    spark = units.sparkSession
    live = _live(spark, path)
    if not live:
        raise ValueError(f"there is no index at {path}")
    if any(r["batch"] == batch for r in live):
        return open_index(spark, path)
    folder = f"{path}/generation-{uuid.uuid4().hex}"
    n, total = _write(active_units(units), spark.read.parquet(f"{live[0]['folder']}/vocabulary"), folder, live[0]["buckets"])
    replaced = _effective(spark, live, "units").join(units.select("id").distinct(), "id", "left_semi")
    replaced.write.parquet(f"{folder}/replaced")
    gone = spark.read.schema(replaced.schema).parquet(f"{folder}/replaced").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    _commit(spark, path, (live[-1]["seq"] + 1, "add", batch, folder, live[0]["buckets"], n, total, gone["n"], gone["total"]))
    return open_index(spark, path)


def _part(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """A table of a generation. Postings are written as lists by token, and are a row for each unit and token again when read;
    those of no units are no files, so their columns are told."""
    if part != "postings":
        return spark.read.parquet(f"{folder}/{part}")
    kind = spark.read.parquet(f"{folder}/units").schema["id"].dataType.simpleString()
    lists = spark.read.schema(f"token string, units array<struct<id: {kind}, len: bigint, tf: bigint>>, bucket int").parquet(f"{folder}/postings")
    return lists.select("token", "bucket", F.inline("units"))


def _effective(spark: SparkSession, live: list[Row], part: str) -> DataFrame:
    """The rows of all generations, without those that a later one replaces."""
    out, later = [], None
    for row in reversed(live):
        own = _part(spark, row["folder"], part)
        out.append(own if later is None else own.join(later, "id", "left_anti").select(*own.columns))
        if row["n_replaced"]:
            ids = spark.read.parquet(f"{row['folder']}/replaced").select("id")
            later = ids if later is None else later.unionByName(ids)
    return reduce(DataFrame.unionByName, reversed(out))


def open_index(spark: SparkSession, path: str) -> WrittenIndex:
    """The index that is committed at ``path``. Readers of some tokens filter postings by ``bucket``, which prunes the folders
    that are listed and read (``indexing.in_buckets``)."""
    live = _live(spark, path)
    if not live:
        raise ValueError(f"there is no index at {path}")
    n = sum(r["n_units"] - r["n_replaced"] for r in live)
    total = sum(r["total_len"] - r["replaced_len"] for r in live)
    stats = spark.createDataFrame([(n, total / n if n else None, live[0]["buckets"])], "n_units long, avg_len double, buckets int")
    tables = {name: _effective(spark, live, name) for name in ("vectors", "postings")}
    return WrittenIndex(tables | {"vocabulary": spark.read.parquet(f"{live[0]['folder']}/vocabulary"), "stats": stats}, len(live))
