"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session may name none. A
    cluster must name one: each machine would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders ``by`` columns of few values, and read it again: lineage
    ends here and a lost executor costs no more than a reread. All tables of an application lie in one folder, to be
    deleted when it has ended."""
    path = f"{shared_dir(df.sparkSession)}/stash-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table that may be broadcast, and tasks that a key of a larger one is dealt to.
MOST_BROADCAST, SALTS = 32_000_000, 64


def join_small(rows: DataFrame, small: DataFrame, on: str, size: int, salt_on: list[str], how: str = "left", most: int = MOST_BROADCAST) -> DataFrame:
    """``rows`` joined to ``small``, a stashed table of about ``size`` bytes with one row for each key, which one key may
    hold a third of the rows of. Up to ``most`` bytes it is broadcast; a larger one has each row copied for SALTS tasks, to
    which the rows of a key are dealt by their columns ``salt_on``."""
    if size <= most:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
