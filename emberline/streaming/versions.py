"""A table that is replaced as a whole: readers see one whole version, and a batch that is run again changes nothing.

Each version is a Parquet folder of its own. It counts once a file in `_commits`, named by its number, tells its folder and the batch it came
from; that file appears by a rename. Older versions stay for readers that are at them, KEPT in all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, the newest one included.
KEPT = 3


class Versions:
    """The versions of the table at a path, in any file system that Spark writes to. One query writes at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [status.getPath().getName() for status in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def commits(self) -> list[dict]:
        """The kept versions, oldest first: number, folder, stream and batch."""
        found = []
        for name in sorted(n for n in self._names(f"{self.path}/_commits") if n.isdigit()):
            file = self.fs.open(self._path(f"{self.path}/_commits/{name}"))
            try:
                found.append(json.loads(bytes(file.readAllBytes()).decode()) | {"number": int(name)})
            finally:
                file.close()
        return found

    def replace(self, rows: DataFrame, stream: str, batch: int) -> bool:
        """Makes the rows the newest version, unless this or a later batch of the stream has been committed; whether it did."""
        before = self.commits()
        if any(c["stream"] == stream and c["batch"] >= batch for c in before):
            return False
        number = before[-1]["number"] + 1 if before else 0
        folder = f"v{number}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(number, {"folder": folder, "stream": stream, "batch": batch})
        self._clean()
        return True

    def _commit(self, number: int, entry: dict) -> None:
        draft, final = (self._path(f"{self.path}/_commits/{name}") for name in (f".{uuid.uuid4().hex}", f"{number:020d}"))
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {number} of {self.path} was committed by another query")

    def _clean(self) -> None:
        """Removes the commits and folders of versions older than those that stay, and folders that were never committed."""
        commits = self.commits()
        stay = {c["folder"] for c in commits[-KEPT:]}
        for c in commits[:-KEPT]:
            self.fs.delete(self._path(f"{self.path}/_commits/{c['number']:020d}"), False)
        for name in self._names(self.path):
            if name.startswith("v") and name not in stay:
                self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def read(self) -> DataFrame:
        """The newest version; an error where there is none."""
        commits = self.commits()
        if not commits:
            raise FileNotFoundError(f"no version of {self.path} has been committed")
        return self.spark.read.parquet(f"{self.path}/{commits[-1]['folder']}")


def shown_at(path: str, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch that replaces what the last batch showed at `path`. A query with a new checkpoint, which counts its batches anew, needs another `stream`."""
    return lambda latest, batch: Versions(latest.sparkSession, path).replace(latest, stream, batch) and None


def read_shown(spark: SparkSession, path: str) -> DataFrame:
    """What is shown at `path`, one whole version."""
    return Versions(spark, path).read()


def upserted_at(path: str) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch that adds a batch's rows to those at `path`, for read_upserted. A batch that is run again replaces its own rows."""
    return lambda rows, batch: rows.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row last sent for each key."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in (*keys, "batch", "place")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct("batch", "place")).alias("r")).select(*keys, "r.*")
