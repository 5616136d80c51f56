"""Missing bars, and sessions between long gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candles import DURATIONS, KEY, VALUES
from .snapshots import CHUNK, in_chunks


def _step(interval: str = "interval") -> Column:
    """The length of a bar, a minute for unknown intervals."""
    minutes = F.lit(1)
    for name, duration in DURATIONS.items():
        amount, unit = duration.split()
        minutes = F.when(F.col(interval) == name, int(amount) * (60 if unit.startswith("hour") else 1)).otherwise(minutes)
    return F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0.0))


def _after_bars(bars: DataFrame, chunk: int) -> DataFrame:
    """The bars with before, the time and close of the one before in the series, and step."""
    order = Window.partitionBy(*KEY, "chunk").orderBy("bar_no")
    placed = in_chunks(bars, 1, chunk).withColumn("before", F.lag(F.struct("time", "close")).over(order))
    return placed.where("home").select(*KEY, "time", *VALUES, "before", _step().alias("step"))


def filled(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The bars, and for each bucket that has none between two of a series one at the close before it, of volume 0; `traded` tells them apart.

    Missing buckets follow each other from the bar before. Bars of no time stay as they are; before the first and after the last bar nothing is missing. A chunk of a series is a
    task's, and a gap is a row until it is filled.
    """
    placed = _after_bars(bars, chunk)
    missing = F.sequence(F.col("before.time") + F.col("step"), F.col("time") - F.expr("INTERVAL '0.000001' SECOND"), F.col("step"))
    gap = placed.where(F.col("before.time") + F.col("step") < F.col("time")).select(*KEY, F.explode(missing).alias("time"), F.col("before.close").alias("close"))
    added = gap.select(*KEY, "time", *[(F.lit(0.0) if c == "volume" else F.col("close")).alias(c) for c in VALUES], F.lit(False).alias("traded"))
    return placed.select(*KEY, "time", *VALUES, F.lit(True).alias("traded")).unionByName(added)


def gaps(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each gap of a series: the times of the bars around it and the number of missing bars."""
    placed = _after_bars(bars, chunk).where(F.col("before.time") + F.col("step") < F.col("time"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    length = F.expr("cast(extract(MINUTE FROM step) + 60 * extract(HOUR FROM step) AS bigint)") * F.lit(60_000_000)
    return placed.select(*KEY, F.col("before.time").alias("after"), F.col("time").alias("until"), (F.ceil((micros("time") - micros("before.time")) / length) - 1).alias("missing"))


def sessions(bars: DataFrame, gap: str) -> DataFrame:
    """The bars of each series as one wide bar for each session, with its last bar's time and number of bars; bars less than `gap` apart, or just so far, are one session.

    For a stream with a watermark on time too, in append mode. Null prices are left out.
    """
    window = F.session_window("time", gap).alias("w")
    return (
        bars.groupBy(*KEY, window)
        .agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.max("time").alias("last_time"), F.count("*").alias("n_bars"))
        .select(*KEY, F.col("w.start").alias("time"), "last_time", "open", "high", "low", "close", "volume", "n_bars")
    )
