"""Helpers that the operators share: reading tables, words, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a maximal run of anything but ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


#: Bytes that Spark hands to Python at a time. Its own default, 64 MB, is held several times over
#: in each of an executor's workers and once more outside the JVM's heap.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the package on the workers, and batches that are
    bounded however long the texts are. A smaller bound that is already set stays."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark's reader touches the path, so any store works."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster
    names one; a local one of our own only where it is unset in local mode (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder: lineage ends there, and lost executors cost
    nothing that can't be read again. For narrow frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as compressed Parquet in the shared folder and reads it again. For wide
    frames that are read more than once. Each application writes below a folder of its own
    name, which can go when the application has ended."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
