"""Bars from files or columns of raw kline payloads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import decode, kline
from ..operators.candles import KEY, newest


def from_payloads(payloads: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """Bars of a table (symbol, interval, body). A body that is no array of arrays raises, or is left out if not `strict`; [] gives no bar."""
    decoded = payloads.withColumn("rows", decode(F.col(body)))
    if strict:
        message = F.concat(F.lit("no kline payload: "), F.coalesce(F.substring(body, 1, 200), F.lit("null")))
        decoded = decoded.withColumn("rows", F.when(F.col("rows").isNull(), F.raise_error(message).cast("array<array<string>>")).otherwise(F.col("rows")))
    return decoded.select("symbol", "interval", F.explode("rows").alias("row")).select("symbol", "interval", *kline(F.col("row"))).drop("time_s")


def read_payload_files(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """Bars of text files that hold one payload each."""
    bodies = spark.read.text(path, wholetext=True).select(F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), F.col("value").alias("body"))
    return from_payloads(bodies)


def payload_body() -> Column:
    """Aggregate: the bars of a group as one kline payload, in order of time."""
    row = F.array(F.unix_millis(F.col("time").cast("timestamp")).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("time", row.alias("k")))), lambda r: r["k"]))


def publish_payloads(bars: DataFrame, folder: str, limit: int = 300) -> DataFrame:
    """Writes the newest `limit` bars of each series as a file SYMBOL-INTERVAL.json in a folder that the tasks can open, and returns (symbol, interval, file).

    The folder then serves as an endpoint for the klines source. A file appears whole, by a rename.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        fs.create_dir(root, recursive=True)
        for batch in batches:
            files = []
            for row in batch.to_pylist():
                draft, name = f"{root}/.{uuid.uuid4().hex}", f"{row['symbol']}-{row['interval']}.json"
                with fs.open_output_stream(draft) as out:
                    out.write(row["body"].encode())
                fs.move(draft, f"{root}/{name}")
                files.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch["symbol"], batch["interval"], pa.array(files, pa.string())], names=["symbol", "interval", "file"])

    bodies = newest(bars, limit).groupBy(*KEY).agg(payload_body().alias("body"))
    return bodies.mapInArrow(write, "symbol string, interval string, file string")
