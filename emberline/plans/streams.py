"""Registered queries that replay the events' bars through the source, the sinks and the streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candles import KEY, SEQUENCE
from ..operators.signals import latest_signals, signals
from ..sources.klines import KlineSource
from ..sources.payloads import publish_payloads
from ..staging import fresh_dir
from ..streaming.alerts import AlertSink, read_alerts
from ..streaming.polling import poll_signals
from ..streaming.stateful import stream_signals
from ..streaming.versions import read_shown, read_upserted, shown_at, upserted_at
from .queries import bars


def klines_source_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' newest bars are published as a payload, and the source's tasks fetch them for the latest signals."""
    spark.dataSource.register(KlineSource)
    folder = fresh_dir(spark, "endpoint")
    published = publish_payloads(bars(spark, sf_dir, by_type=True), folder).collect()  # a row for each series that is asked for
    url = f"{folder if ':' in folder else 'file://' + folder}/{{symbol}}-{{interval}}.json"
    reader = spark.read.format("klines").option("url", url).option("symbols", ",".join(sorted(r["symbol"] for r in published))).option("intervals", ",".join(sorted({r["interval"] for r in published})))
    return latest_signals(reader.load())


def _versions(spark: SparkSession, sf_dir: str, by_type: bool, number: int) -> DataFrame:
    """The bars with SEQUENCE; of the earlier number every seventh bar's close is not yet what it will be."""
    rows = bars(spark, sf_dir, by_type=by_type).withColumn(SEQUENCE, F.lit(number).cast("long"))
    return rows if number else rows.withColumn("close", F.when(F.pmod(F.hash("time"), F.lit(7)) == 0, F.col("close") + 0.5).otherwise(F.col("close")))


def polled_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that hold two versions of some bars are polled, and what the last poll showed is read back."""
    table, folder = fresh_dir(spark, "snapshots"), fresh_dir(spark, "poll")
    _versions(spark, sf_dir, True, 1).unionByName(_versions(spark, sf_dir, True, 0)).write.parquet(table)
    snapshots = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    poll_signals(snapshots, shown_at(f"{folder}/shown"), seconds=None, checkpointLocation=f"{folder}/checkpoint").awaitTermination()
    return read_shown(spark, f"{folder}/shown")


def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars come as a stream, some of them twice, and the earlier version after the later one; the last signal sent for each bar is read back.

    A batch holds a month of five-minute bars, 8,928 at most. What is too late to be judged (n_bars 0) replaces nothing."""
    table, folder = fresh_dir(spark, "bars"), fresh_dir(spark, "stream")
    for number in (1, 0):
        rows = _versions(spark, sf_dir, False, number)
        rows.write.mode("append").parquet(table)
        stream = spark.readStream.schema(rows.schema).parquet(table)
        writer = stream_signals(stream).where("n_bars > 0").writeStream.foreachBatch(upserted_at(f"{folder}/signals"))
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_upserted(spark, f"{folder}/signals", [*KEY, "time"])


def alerts_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals at every bar come as a stream, each of them in two batches, and the outbox is read back: one alert for each signal."""
    spark.dataSource.register(AlertSink)
    table, folder = fresh_dir(spark, "signals"), fresh_dir(spark, "alerts")
    made = signals(bars(spark, sf_dir, by_type=True))
    for _ in range(2):
        made.write.mode("append").parquet(table)
        writer = spark.readStream.schema(made.schema).parquet(table).writeStream.format("alerts").option("path", f"{folder}/outbox")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_alerts(spark, f"{folder}/outbox")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"klines_source_latest": klines_source_latest, "polled_latest": polled_latest, "streamed_history": streamed_history, "alerts_sent": alerts_sent}
