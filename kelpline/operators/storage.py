"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode, where it may be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession) -> str:
    """A folder for tables of this application; all of them lie in one, to be deleted when it has ended."""
    return f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: what is read twice is made once, and lineage ends here."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path`` with all that is below it; None where nothing was ever written."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
