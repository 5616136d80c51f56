"""What a chart shows of a snapshot and its signal, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import price, to_fixed
from ..functions.indicators import ema_series, rsi_series
from .candles import KEY, clean, newest

# The page's own words.
PORTUGUESE = {"BUY": "COMPRA", "SELL": "VENDA", "NONE": "SEM SINAL"}


def _snapshot(bars: DataFrame) -> DataFrame:
    """One row per series: times and closes of its newest snapshot, oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("time", "close")))
    return newest(clean(bars)).groupBy(*KEY).agg(ordered.alias("bars")).select(*KEY, F.col("bars.time").alias("times"), F.col("bars.close").alias("closes"))


def ema_lines(bars: DataFrame) -> DataFrame:
    """The line points of both averages over the newest snapshot: bars and values are zipped by index."""
    lines = _snapshot(bars).select(*KEY, "times", ema_series(F.col("closes"), 9).alias("ema9"), ema_series(F.col("closes"), 21).alias("ema21"))
    return lines.select(*KEY, F.explode(F.arrays_zip("times", "ema9", "ema21")).alias("p")).select(*KEY, F.col("p.times").alias("time"), "p.ema9", "p.ema21")


def rsi_points(bars: DataFrame) -> DataFrame:
    """The strength index over the newest snapshot by its own index: a placeholder of 50, then a value from bar 14 on."""
    return _snapshot(bars).select(*KEY, F.posexplode(rsi_series(F.col("closes"), 14)).alias("index", "rsi"))


def price_lines(signals: DataFrame) -> DataFrame:
    """Entry, stop and take of every signal as a row each."""
    line = lambda kind, style, title: F.struct(F.lit(kind).alias("line"), F.col(kind).alias("price"), F.lit(style).alias("style"), F.lit(title).alias("title"))
    lines = F.array(line("entry", "dashed", "Entry"), line("stop", "dotted", "Stop"), line("take", "dotted", "Take 1:1.5"))
    return signals.where("direction <> 'NONE'").select(*KEY, "time", F.explode(lines).alias("l")).select(*KEY, "time", "l.*")


def _direction(labels: dict[str, str] | None) -> Column:
    """The direction, in the words of `labels` (BUY, SELL and NONE to text) where it has them."""
    shown = F.col("direction")
    for direction, text in (labels or {}).items():
        shown = F.when(F.col("direction") == direction, text).otherwise(shown)
    return shown


def markers(signals: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """An arrow for every signal, its text in the words of `labels` (such as PORTUGUESE) if given."""
    buy = F.col("direction") == "BUY"
    return signals.where("direction <> 'NONE'").select(
        *KEY, "time", F.when(buy, "belowBar").otherwise("aboveBar").alias("position"), F.when(buy, "#00ff88").otherwise("#ff4444").alias("color"),
        F.when(buy, "arrowUp").otherwise("arrowDown").alias("shape"), _direction(labels).alias("text"),
    )


def panel(signals: DataFrame, labels: dict[str, str] | None = None, updated: Column | None = None) -> DataFrame:
    """The information panel's texts for every signal row; `labels` as for markers.

    With `updated`, a timestamp such as current_timestamp(), also last_update, its time of day in the session's time zone.
    """
    css = F.when(F.col("direction") == "BUY", "buy").when(F.col("direction") == "SELL", "sell").otherwise("none")
    dollars = lambda c: F.concat(F.lit("US$ "), to_fixed(F.col(c), 2)).alias(c)
    clock = [] if updated is None else [F.concat(F.lit("Atualizado: "), F.date_format(updated, "HH:mm:ss")).alias("last_update")]
    return signals.select(
        *KEY, "time", _direction(labels).alias("direction"), F.concat(F.lit("signal "), css).alias("css_class"), *[price(F.col(c)).alias(c) for c in ("entry", "stop", "take")], "rr",
        dollars("atr"), dollars("ema9"), dollars("ema21"), to_fixed(F.col("rsi"), 1).alias("rsi"), F.when(F.col("vol_spike"), "↑").otherwise("—").alias("vol"), *clock,
    )
