"""Bars: resampling, selection and ordering.

A bar is (symbol, interval, time, open, high, low, close, volume). Bars are ordered by time within (symbol, interval).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

BAR = "symbol string, interval string, time timestamp_ntz, open double, high double, low double, close double, volume double"
KEY = ["symbol", "interval"]
VALUES = ["open", "high", "low", "close", "volume"]
#: An optional column of bars: the larger it is, the newer is this version of the bar. Sources that poll number their answers with it.
SEQUENCE = "seq"
#: Spark durations of the supported intervals.
DURATIONS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour"}


def tick_place(ticks: DataFrame, time: str, order: str) -> Column:
    """A tick's place in the order of time and then `order`, a null one first. Of a timestamp and a whole number one decimal is
    made, which Spark aggregates by hash; it sorts rows to aggregate structs."""
    kinds = dict(ticks.dtypes)
    if kinds.get(order) not in ("tinyint", "smallint", "int", "bigint") or not kinds.get(time, "").startswith("timestamp"):
        return F.struct(time, order)
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(20,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)")
    return (micros + F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63))).cast("decimal(20,0)")).cast("decimal(38,0)")


def partial_bars(ticks: DataFrame, interval: str, symbol: Column | None = None, time: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """Bars with open_at and close_at, the places of their first and last tick, so that merge_bars can put parts of a bar together in any order.

    Volume is the number of ticks, empty buckets give no bar. Partial aggregates meet at (symbol, bucket), so a busy symbol is spread over its buckets.
    """
    at = tick_place(ticks, time, order)
    price = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    return (
        ticks.withColumn("symbol", symbol if symbol is not None else F.lit("ALL"))
        .groupBy("symbol", F.window(F.col(time), DURATIONS[interval]).alias("w"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"),
            F.min(at).alias("open_at"), F.max(at).alias("close_at"),
        )
        .select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "open_at", "close_at")
    )


def merge_bars(parts: DataFrame, interval: str | None = None) -> DataFrame:
    """Parts of bars (see partial_bars) as whole ones, still with their places, or as bars of a wider interval that theirs divides.

    Merging is associative and doesn't care for order: parts of the same bucket from several tables, days or late ticks, merged parts too. A part
    without places merges by its time. A null volume counts for nothing.
    """
    bucket = F.col("time") if interval is None else F.window("time", DURATIONS[interval])["start"]
    first, last = F.struct("open_at", "time"), F.struct("close_at", "time")
    return (
        parts.groupBy("symbol", F.col("interval") if interval is None else F.lit(interval).alias("interval"), bucket.alias("bucket"))
        .agg(
            F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"),
            F.min("open_at").alias("open_at"), F.max("close_at").alias("close_at"),
        )
        .select("symbol", "interval", F.col("bucket").alias("time"), "open", "high", "low", "close", "volume", "open_at", "close_at")
    )


def every_interval(ticks: DataFrame, intervals: list[str], symbol: Column | None = None) -> DataFrame:
    """Bars of several intervals, each of which the first one divides, from one pass over the ticks: wider bars are merged from the first one's, which are written to the shared folder."""
    narrow = staged(partial_bars(ticks, intervals[0], symbol), "partial-bars")
    found = narrow
    for interval in intervals[1:]:
        found = found.unionByName(merge_bars(narrow, interval))
    return found.select(*KEY, "time", *VALUES)


def from_ticks(ticks: DataFrame, interval: str, symbol: Column | None = None, time: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """Resample ticks to bars (see partial_bars)."""
    return partial_bars(ticks, interval, symbol, time, value, order).drop("open_at", "close_at")


def select_series(bars: DataFrame, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """The bars of a symbol and an interval; the filter reaches the scan."""
    if symbol is not None:
        bars = bars.where(F.col("symbol") == symbol)
    return bars if interval is None else bars.where(F.col("interval") == interval)


def clean(bars: DataFrame, *more: str) -> DataFrame:
    """The columns of a bar alone, and those in `more`, with NaN for prices and volumes that are null: aggregates over rows would skip those."""
    return bars.select(*KEY, "time", *more, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in VALUES])


def newest_versions(bars: DataFrame) -> DataFrame:
    """One row for each time of a series, without SEQUENCE: that of the largest SEQUENCE, a null one being the least, and of equal or no ones that of the larger values."""
    order = F.struct(*([SEQUENCE] if SEQUENCE in bars.columns else []), *VALUES)
    return bars.groupBy(*KEY, "time").agg(F.max(order).alias("v")).select(*KEY, "time", *(f"v.{c}" for c in VALUES))


def newest(bars: DataFrame, limit: int = 300) -> DataFrame:
    """The newest `limit` bars of each series; of equal times the larger values are newer."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("time"), *[F.desc(c) for c in VALUES]))
    return bars.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def closed_only(bars: DataFrame) -> DataFrame:
    """The bars without the last of each series, which may still be forming. Last times are aggregated first, so a long series fills many tasks."""
    last = bars.groupBy(*[F.col(c).alias(f"last_{c}") for c in KEY]).agg(F.max("time").alias("last_time"))
    same = [F.col(c).eqNullSafe(F.col(f"last_{c}")) for c in KEY]
    return bars.join(last, [*same, F.col("time") >= F.col("last_time")], "left_anti").where("time IS NOT NULL")


def numbered(bars: DataFrame) -> DataFrame:
    """The bars, cleaned, with bar_no, the bar's number in its series from 0; equal times are ordered by their values.

    Days are numbered apart and offset by the days before, so no task holds a whole series.
    """
    daily = clean(bars).withColumn("day", F.to_date("time"))
    before = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = daily.groupBy(*KEY, "day").agg(F.count("*").alias("bars")).select(*[F.col(c).alias(f"of_{c}") for c in (*KEY, "day")], F.coalesce(F.sum("bars").over(before), F.lit(0)).alias("offset"))
    in_day = F.row_number().over(Window.partitionBy(*KEY, "day").orderBy("time", *VALUES)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*KEY, "day")]
    placed = daily.withColumn("in_day", in_day).join(offsets, same)
    return placed.select(*KEY, "time", *VALUES, (F.col("offset") + F.col("in_day")).alias("bar_no"))
