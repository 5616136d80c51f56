"""Alerts of a stream of signals: a sink that sends one for each (symbol, interval, time, direction), however often a batch runs.

    spark.dataSource.register(AlertSink)
    stream_signals(bars).writeStream.format("alerts").option("path", outbox).option("checkpointLocation", ...).start()

The outbox is a folder with a JSON file for each alert, named by its key. Tasks write drafts; what a batch wrote is put into the outbox once the batch is
committed, and alerts that lie there already, from an earlier run of the batch or from a bar that came again, are not sent anew. Drafts of an aborted batch go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ALERT = "symbol string, interval string, time string, direction string, entry double, stop double, take double, rr string"
_FIELDS = [x.split()[0] for x in ALERT.split(", ")]


@dataclass
class Drafted(WriterCommitMessage):
    """The drafts of one task: (file, name of the alert)."""

    drafts: list[tuple[str, str]]


def alert_name(row: dict) -> str:
    """The alert's file: its key, with whatever a file name can't hold as hexadecimal."""
    safe = lambda value: "".join(c if c.isalnum() and c.isascii() else f"_{ord(c):x}_" for c in str(value))
    return "-".join(safe(row[c]) for c in ("symbol", "interval", "time", "direction")) + ".json"


class AlertWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path:
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path.removeprefix("file:")

    def write(self, iterator: Iterator[Row]) -> Drafted:
        fs, root = self._open()
        drafts = []
        for row in iterator:
            alert = row.asDict()
            if alert.get("direction") not in ("BUY", "SELL"):
                continue
            alert = {c: None if alert.get(c) is None else str(alert[c]) if c == "time" else alert[c] for c in _FIELDS}
            if not drafts:
                fs.create_dir(f"{root}/_drafts", recursive=True)
            draft = f"_drafts/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{root}/{draft}") as out:
                out.write(json.dumps(alert).encode())
            drafts.append((draft, alert_name(alert)))
        return Drafted(drafts)

    def _drafts(self, fs: pafs.FileSystem, root: str, messages: list[WriterCommitMessage | None]) -> Iterator[tuple[str, str]]:
        """The drafts that are still there, as (path, name of the alert)."""
        for draft, name in (d for m in messages if m is not None for d in m.drafts):
            if fs.get_file_info(f"{root}/{draft}").type != pafs.FileType.NotFound:
                yield f"{root}/{draft}", name

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        for draft, name in self._drafts(fs, root, messages):
            if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                fs.move(draft, f"{root}/{name}")
            else:
                fs.delete_file(draft)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs, root = self._open()
        for draft, _ in self._drafts(fs, root, messages):
            fs.delete_file(draft)


class AlertSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alerts"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return AlertWriter(self.options["path"])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts that have been sent; none where the outbox is empty."""
    return spark.read.schema(ALERT).option("pathGlobFilter", "*.json").json(path).selectExpr(*(f"{c}" if c != "time" else "cast(time AS timestamp_ntz) AS time" for c in _FIELDS))
