"""Signals from a stateless poll of whole snapshots, and bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.candles import DURATIONS, newest_versions, tick_place
from ..operators.signals import latest_signals
from .stateful import stream_signals, trailing_indicators
from .versions import read_shown, shown_at

__all__ = ["bars_of_stream", "poll_signals", "read_shown", "shown_at", "stream_signals", "trailing_indicators"]


def poll_signals(snapshots: DataFrame, handle: Callable[[DataFrame, int], None], seconds: int | None = 30, **options: str) -> StreamingQuery:
    """Every micro-batch is a full snapshot of each series; `handle` gets its latest signals and the batch number.

    Nothing is carried over: what an earlier batch showed is replaced. Where a batch holds several versions of a bar, the one with the largest `seq` counts
    (see newest_versions). `seconds` None takes what is there and stops.
    """
    writer = snapshots.writeStream.options(**options).foreachBatch(lambda batch, n: handle(latest_signals(newest_versions(batch)), n))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def bars_of_stream(ticks: DataFrame, interval: str, late: str = "1 hour", symbol: str | Column = "ALL") -> DataFrame:
    """Bars of a stream of (ts, event_id, value), each sent once the watermark has passed its end; `symbol` is the one of all ticks, or a column of them."""
    named = ticks.withColumn("symbol", F.lit(symbol) if isinstance(symbol, str) else symbol).withColumn("ts", F.col("ts").cast("timestamp"))
    at, price = tick_place(named, "ts", "event_id"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    return (
        named.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", DURATIONS[interval]).alias("w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit(interval).alias("interval"), F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "volume")
    )
