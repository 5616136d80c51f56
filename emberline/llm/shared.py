"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set once a session without spark.checkpoint.dir (a local test session) gets its own folder.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set on the context; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() if not _OWN else None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="spark-emberline-")
        spark.sparkContext.setCheckpointDir(_OWN[key])
    return _OWN[key]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder in the shared root."""
    return f"{shared_root(spark).rstrip('/')}/emberline-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Lineage ends there (a lost executor costs nothing that came before), and the files' size
    tells Spark whether a later join may broadcast the table.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or plain local path, for use in tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns (Spark tells no upper from lower case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


#: Bits of the index of a filter word of 64 bits: a hash filter has at most 2 ** 18 rows, 4 MB, whatever it is made of.
FILTER_BITS = 18


def _filter_word(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - FILTER_BITS)


def _filter_bit(hashed: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))


def hash_filter(df: DataFrame, hashed: str, name: str) -> DataFrame:
    """(word, bits): which cells the 64-bit hashes of a column fall in, for may_hold."""
    return staged(df.groupBy(_filter_word(F.col(hashed)).alias("word")).agg(F.bit_or(_filter_bit(F.col(hashed))).alias("bits")), name)


def may_hold(df: DataFrame, cells: DataFrame, hashed: str) -> DataFrame:
    """The rows whose hash falls in a cell of the filter: all that are in it, and few others while it is sparse."""
    word, bits = unused(df.columns, "word", "bits")
    met = df.join(F.broadcast(cells.toDF(word, bits)), _filter_word(F.col(hashed)) == F.col(word))
    return met.where(F.col(bits).bitwiseAND(_filter_bit(F.col(hashed))) != 0).drop(word, bits)



def lacks(df: DataFrame, cells: DataFrame, hashed: str) -> DataFrame:
    """The rows that may_hold leaves out, those of a null hash too."""
    word, bits = unused(df.columns, "word", "bits")
    met = df.join(F.broadcast(cells.toDF(word, bits)), _filter_word(F.col(hashed)) == F.col(word), "left")
    return met.where(F.coalesce(F.col(bits).bitwiseAND(_filter_bit(F.col(hashed))), F.lit(0)) == 0).drop(word, bits)
