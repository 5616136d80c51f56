"""Tables written to a folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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
